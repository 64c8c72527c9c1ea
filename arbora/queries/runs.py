"""Queries on many runs at once: searches, folders of inputs, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators import trees as T
from arbora.operators.search import SearchParams, package, search
from arbora.plans import shared_dir
from arbora.queries.analysis import PMF_SQL
from arbora.queries.reads import F_HAT_SQL, r6
from arbora.queries.trees import PARENTS_SQL, TREE_LLH_SQL, tree_frequencies, tree_likelihoods
from arbora.sources import archive, batch
from arbora.sources import views as S
from arbora.sources.formats import matrix_column
from arbora.sources.views import with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: All trees of each pair of nodes (one tree for the node left over) with their fits, which have closed forms: a projection onto
#: a simplex for the star, a weighted mean where a child would exceed its parent.
PAIRS_SQL = """, h AS (SELECT CAST(ceil(node / 2.0) AS INT) AS run, 2 - node % 2 AS node, sample, v, n, omega, least(1.0, v / (omega * n)) AS t,
  greatest(1e-4, (v + 1.0) * (1.0 - (v + 1.0) / (n + 2.0)) / pow((n + 2.0) * omega, 2)) AS w FROM cells),
ab AS (SELECT a.run, a.sample, a.t AS ta, a.w AS wa, b.t AS tb, b.w AS wb, greatest(0, a.t + b.t - 1) / (a.w + b.w) AS e, (a.t / a.w + b.t / b.w) / (1 / a.w + 1 / b.w) AS m
  FROM h a JOIN h b ON a.run = b.run AND a.sample = b.sample AND a.node = 1 AND b.node = 2),
fits AS (SELECT run, sample, [0, 0] AS parents, [ta - e * wa, tb - e * wb] AS f FROM ab
  UNION ALL SELECT run, sample, [0, 1], CASE WHEN ta >= tb THEN [ta, tb] ELSE [m, m] END FROM ab UNION ALL SELECT run, sample, [2, 0], CASE WHEN tb >= ta THEN [ta, tb] ELSE [m, m] END FROM ab
  UNION ALL SELECT run, sample, [0], [t] FROM h WHERE run NOT IN (SELECT run FROM ab)),
fp AS (SELECT fits.run, parents, v, n, least(greatest(omega * f[node], 1e-5), 1 - 1e-5) AS p FROM fits JOIN h USING (run, sample)),
every AS (SELECT run, parents, sum(""" + PMF_SQL + """) AS llh FROM fp GROUP BY run, parents)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes 1 and 2, 3 and 4, ... as the nodes 1 and 2 of a run each."""
    c = S.cells(spark, d)
    return c.withColumns({"run": F.ceil(F.col("node") / 2).cast("int"), "node": (2 - F.col("node") % 2).cast("int")})


@query(
    with_views(
        "cells",
        PAIRS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY llh DESC, parents) AS rank FROM every), k AS (SELECT * FROM r WHERE rank <= 2)
SELECT run, CAST(rank AS INT) AS rank, parents, 2::BIGINT AS count, round(llh, 6) + 0.0 AS llh, CAST(len(parents) - len(list_distinct(parents)) AS INT) AS parsimony,
  round(exp(llh - max(llh) OVER (PARTITION BY run)) / (SELECT sum(exp(o.llh - (SELECT max(x.llh) FROM k x WHERE x.run = k.run))) FROM k o WHERE o.run = k.run), 6) + 0.0 AS prob FROM k""",
    )
)
def search_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of nodes as a run of its own: the best two of its three trees, by two instances of different node orders, packaged."""
    p = SearchParams(beam_width=2, branching_factor=10, instances=2, seed=5, node_order="diverse", model="bs")
    rows = package(search(_pairs(spark, d), p), ["run"])
    return rows.select("run", "rank", "parents", "count", r6("llh").alias("llh"), "parsimony", r6("prob").alias("prob"))


@query(
    with_views(
        "cells",
        PAIRS_SQL + """, o AS (SELECT run, CASE WHEN count(*) = 1 THEN '-1' WHEN round(max(s) FILTER (node = 1), 9) >= round(max(s) FILTER (node = 2), 9) THEN '0,-1' ELSE '-1,0' END AS origin
  FROM (SELECT run, node, sum(v / (n * omega)) AS s FROM h GROUP BY run, node) GROUP BY run),
g AS (SELECT run, parents, llh, llh - ln(-ln((('0x' || md5('5|0|' || origin || '|' || array_to_string(parents, ','))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS g FROM every JOIN o USING (run)),
z AS (SELECT *, max(g) OVER (PARTITION BY run) AS z, count(*) OVER (PARTITION BY run) AS made FROM g),
v AS (SELECT *, CASE WHEN g < z THEN -g + ln(1 - exp(g - z)) END AS v FROM z),
s AS (SELECT *, CASE WHEN v IS NULL THEN 0.0 ELSE greatest(v, 0.0) + ln(1 + exp(-abs(v))) END AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, parents) AS rn FROM s)
SELECT run, parents, round(llh, 6) + 0.0 AS llh, round(score, 5) + 0.0 AS score, CAST(CASE WHEN made = 1 THEN 1 ELSE 2 END AS BIGINT) AS explored, CAST(greatest(made - 2, 0) AS BIGINT) AS cut FROM r WHERE rn <= 2""",
    )
)
def search_pairs_stochastic(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of nodes as a run of its own: two of its three trees by perturbed scores, conditioned on their parent's."""
    rows = search(_pairs(spark, d), SearchParams(beam_width=2, branching_factor=10, seed=5))
    return rows.select("run", "parents", r6("llh").alias("llh"), (F.round("score", 5) + 0.0).alias("score"), "explored", "cut")


#: The samples: the five regions.
REGIONS = range(5)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/arbora/{uuid.uuid4().hex}"


@query(
    with_views(
        "mut_cells",
        """, m AS (SELECT 'run' || (node % 5) AS run, CAST(dense_rank() OVER (PARTITION BY node % 5 ORDER BY node) AS INT) AS node, sample, v, n, omega FROM mut_cells)
SELECT run, node, sample, CAST(least(sum(v), floor(sum(2.0 * n * omega))) AS BIGINT) AS v, CAST(floor(sum(2.0 * n * omega)) AS BIGINT) AS n, 0.5::DOUBLE AS omega FROM m WHERE run <> 'run3' GROUP BY ALL""",
    )
)
def folder_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Mutation and parameter files of five runs, written from the reads and read again as one folder. The probabilities of one
    run are out of range: it is set aside."""
    base, c = _scratch(spark), S.mut_cells(spark, d)
    c = c.withColumns({"run": F.concat(F.lit("run"), F.col("node") % 5), "id": F.concat(F.lit("s"), "mut")})
    filled = c.select("id", "run", "node").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, REGIONS)))).join(c.select("id", "sample", "v", "n"), ["id", "sample"], "left")
    listed = filled.groupBy("run", "node", "id").agg(F.array_sort(F.collect_list(F.struct("sample", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    text = lambda value: F.array_join(F.transform("x", value), ",")
    chance = F.when(F.col("run") == "run3", "1.5").otherwise("0.5")
    files = listed.select("run", "id", F.concat(F.lit("name of "), "id").alias("name"), text(lambda x: x["v"].cast("string")).alias("var_reads"), text(lambda x: x["n"].cast("string")).alias("total_reads"), text(lambda x: chance).alias("var_read_prob"))
    files.write.partitionBy("run").csv(f"{base}/mutations", sep="\t", header=True)
    clusters = listed.groupBy("run", "node").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "ids"))), lambda x: x["ids"]).alias("clusters"))
    samples = F.array(*[F.lit(f"sample {s}") for s in REGIONS])
    clusters.select("run", samples.alias("samples"), "clusters").repartition("run").write.partitionBy("run").json(f"{base}/params")
    return batch.read_inputs(spark, base, mutations="*.csv", parameters="*.json", by_folder=True)[0]


@query(
    with_views(
        "cells tree_set",
        F_HAT_SQL + TREE_LLH_SQL + PARENTS_SQL + """, rw AS (SELECT t, node, list(round(f, 6) + 0.0 ORDER BY sample) AS r FROM fx GROUP BY t, node), ph AS (SELECT t, list(r ORDER BY node) AS phi FROM rw GROUP BY t)
SELECT 'm' || (t % 2) AS run, CAST(t // 2 AS INT) AS tree_idx, parents, phi, t + 1 AS count, round(llh, 6) + 0.0 AS llh, [['s' || (t % 2), 'a'], ['b']] AS clusters, 7::BIGINT AS seed FROM pv JOIN ph USING (t) JOIN tl USING (t)""",
    )
)
def archives(spark: SparkSession, d: str) -> DataFrame:
    """Two result archives of four trees each, written and read again."""
    base = f"{_scratch(spark)}/archives"
    trees = T.parents_of(S.tree_set(spark, d), ["t"]).join(matrix_column(tree_frequencies(spark, d), "f", ["t"]).withColumnRenamed("matrix", "phi"), "t").join(tree_likelihoods(spark, d), "t")
    kind = F.col("t") % 2
    phi = F.transform("phi", lambda row: F.transform(row, lambda x: F.round(x, 6) + 0.0))
    clusters = F.array(F.array(F.concat(F.lit("s"), kind), F.lit("a")), F.array(F.lit("b")))
    rows = trees.select(F.concat(F.lit("m"), kind).alias("run"), F.floor(F.col("t") / 2).cast("int").alias("tree_idx"), "parents", phi.alias("phi"), (F.col("t") + 1).cast("bigint").alias("count"), r6("llh").alias("llh"), clusters.alias("clusters"), F.lit(7).cast("bigint").alias("seed"))
    archive.write_archives(rows, base)
    return archive.read_archives(spark, base, ["parents", "phi", "count", "llh", "clusters", "seed"]).drop("path")
