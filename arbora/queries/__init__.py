"""Registered queries by topic. Each module has QUERIES (name -> function) and ORACLE (name -> SQL)."""
