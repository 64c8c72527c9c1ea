"""Phylogeny operators: DataFrame in, DataFrame out."""
