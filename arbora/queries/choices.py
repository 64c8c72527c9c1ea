"""Queries that choose: placements under restrictions, clone trees by criteria or size; and the error that plots add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import cluster as C
from arbora.operators import placement as P
from arbora.operators import plotdata as V
from arbora.queries.analysis import ORACLE as ANALYSIS_SQL
from arbora.queries.analysis import PLACE_SQL, _half_placed, pac_segments
from arbora.queries.reads import F_HAT_SQL, r6
from arbora.queries.runs import _scratch
from arbora.queries.trees import TREE_LLH_SQL, tree_frequencies
from arbora.sources import views as S
from arbora.sources.formats import read_clusterings, write_clusterings
from arbora.sources.views import with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    with_views(
        "cells tree_heap",
        F_HAT_SQL + PLACE_SQL + """, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY u)) AS e FROM sc WHERE v > 0 OR model = 1), p AS (SELECT *, e / sum(e) OVER (PARTITION BY u) AS prob FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(prob, 12) DESC, v, model, c) - 1 AS i FROM p)
SELECT u, CAST(i AS INT) AS i, round(prob, 6) + 0.0 AS prob FROM r WHERE i < 8 AND prob > 0""",
    )
)
def placement_monoprimary(spark: SparkSession, d: str) -> DataFrame:
    """The eight likeliest placements of each node where no second leaf may hang off the root, without those of probability zero."""
    scored = P.scores(P.candidates(_half_placed(spark, d), monoprimary=True))
    return P.best(scored, ["u"], 8, ignore_zero_probs=True).select("u", "i", r6("prob").alias("prob"))


@query(
    with_views(
        "cells tree_set",
        F_HAT_SQL + TREE_LLH_SQL + " SELECT t, round(sum(abs(100 * least(1.0, v / (n * omega)) - 100 * f)), 6) + 0.0 AS error FROM fx JOIN cells USING (node, sample) GROUP BY t",
    )
)
def plot_error(spark: SparkSession, d: str) -> DataFrame:
    """For each tree of the set, the summed differences of its frequencies from the implied ones, in percent."""
    cells, freq = S.cells(spark, d), tree_frequencies(spark, d)
    trees = [r["t"] for r in freq.select("t").distinct().orderBy("t").collect()]  # the eight trees of the view
    of = lambda t: V.total_error(V.prevalence_table(cells, freq.where(F.col("t") == t))).select(F.lit(t).cast("int").alias("t"), r6("error").alias("error"))
    return reduce(DataFrame.unionByName, map(of, trees))


@query(
    "WITH s AS ("
    + ANALYSIS_SQL["pac_segments"]
    + """), q AS (SELECT s.*, 2.0 * size * 5 * ln(4) - 2 * llh AS bic, 2.0 * size * 5 * ln(4) * ln(5) - 2 * llh AS gic FROM s)
SELECT 'bic' AS kind, * EXCLUDE (bic, gic) FROM (SELECT * FROM q ORDER BY bic, size DESC LIMIT 1) UNION ALL SELECT 'gic', * EXCLUDE (bic, gic) FROM (SELECT * FROM q ORDER BY gic, size DESC LIMIT 1)
UNION ALL SELECT 'two clones', * EXCLUDE (bic, gic) FROM q WHERE size = 2"""
)
def clone_tree_choice(spark: SparkSession, d: str) -> DataFrame:
    """The clone trees of ``pac_segments``, written as clusterings and read again: those of the least BIC, of the least GIC, and of
    two clones."""
    path = f"{_scratch(spark)}/clusterings"
    rows = pac_segments(spark, d)
    write_clusterings(rows.withColumns({"step": (4 - F.col("size")).cast("int"), "sv_clusters": F.col("clusters").cast("array<array<string>>"), "clusters": F.col("clusters").cast("array<array<string>>")}), path)
    rows = read_clusterings(spark, path).withColumns({"tree": F.lit(0), "clusters": F.col("clusters").cast("array<array<int>>")})
    n, m = F.lit(4), F.lit(5)
    chosen = {"bic": C.select_clustering(rows, n, m), "gic": C.select_clustering(rows, n, m, "gic"), "two clones": C.select_clustering(rows, n, m, num_clones=2)}
    return reduce(DataFrame.unionByName, [x.select(F.lit(kind).alias("kind"), "size", "parents", "clusters", "llh") for kind, x in chosen.items()])
