"""Queries on clusterings, metrics, placements, fits and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import gumbel, gumbel_with_maximum, key_uniform, softmax
from arbora.operators import cluster as C
from arbora.operators import metrics as M
from arbora.operators import placement as P
from arbora.operators import plotdata as V
from arbora.operators import reads as R
from arbora.operators import trees as T
from arbora.operators.fit import fit_trees, frequencies, pack
from arbora.operators.rank import exact_quantiles
from arbora.operators.search import SearchParams, package, search
from arbora.queries.reads import F_HAT_SQL, r6
from arbora.queries.trees import PARENTS_SQL, TREE_LLH_SQL, tree_frequencies, tree_likelihoods
from arbora.sources import views as S
from arbora.sources.views import with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PMF_SQL = "lgamma(n + 1.0) - lgamma(v + 1.0) - lgamma(n - v + 1.0) + v * ln(p) + (n - v) * ln(1.0 - p)"


def _sampled_trees(spark: SparkSession, d: str) -> DataFrame:
    """method, tree, llh, count: two methods, four trees each, as if each had been found t + 1 times."""
    return tree_likelihoods(spark, d).select((F.col("t") % 2).cast("string").alias("method"), F.col("t").alias("tree"), "llh", (F.col("t") + 1).alias("count"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return S.mut_cells(spark, d).select("mut", "node").distinct()


@query(with_views("mut_cells", " SELECT DISTINCT mut AS id, node AS clusters FROM mut_cells"))
def membership(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select(F.col("mut").alias("id"), F.col("node").alias("clusters"))


W_SQL = ", m AS (SELECT CAST(t % 2 AS VARCHAR) AS method, t AS tree, llh, t + 1 AS count FROM tl)"
PERPLEXITY_SQL = """, s AS (SELECT w.method, w.tree, w.w, v, n, mut, sample, least(greatest(omega * f, 1e-5), 1 - 1e-5) AS p FROM w
  JOIN fx ON fx.t = w.tree JOIN mut_cells USING (node, sample))
SELECT method, round(-sum(w * (""" + PMF_SQL + """)) / count(DISTINCT (mut, sample)) / ln(2), 6) + 0.0 AS score FROM s GROUP BY method"""


@query(with_views("cells mut_cells tree_set", F_HAT_SQL + TREE_LLH_SQL + W_SQL + ", w0 AS (SELECT method, tree, exp(llh - max(llh) OVER (PARTITION BY method)) AS e FROM m), w AS (SELECT method, tree, e / sum(e) OVER (PARTITION BY method) AS w FROM w0)" + PERPLEXITY_SQL))
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    trees = _sampled_trees(spark, d)
    freq = tree_frequencies(spark, d).withColumnRenamed("t", "tree").withColumn("method", (F.col("tree") % 2).cast("string"))
    return M.perplexity(trees, freq, _members(spark, d), S.mut_cells(spark, d)).withColumn("score", r6("score"))


@query(with_views("cells mut_cells tree_set", F_HAT_SQL + TREE_LLH_SQL + W_SQL + ", w AS (SELECT method, tree, 1.0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY llh DESC, tree) AS r FROM m) WHERE r = 1)" + PERPLEXITY_SQL))
def perplexity_top(spark: SparkSession, d: str) -> DataFrame:
    trees = _sampled_trees(spark, d)
    freq = tree_frequencies(spark, d).withColumnRenamed("t", "tree").withColumn("method", (F.col("tree") % 2).cast("string"))
    return M.perplexity(trees, freq, _members(spark, d), S.mut_cells(spark, d), top_tree=True).withColumn("score", r6("score"))


PER_SQL = """, g AS (SELECT a.t, a.node AS i, b.node AS j, a.parent AS pi, b.parent AS pj FROM tree_set a JOIN tree_set b ON a.t = b.t),
per AS (SELECT t, i, j, 0 AS rel FROM g WHERE pj = i OR i = j UNION ALL SELECT t, i, j, 1 FROM g WHERE pi = j OR i = j
  UNION ALL SELECT t, i, j, 2 FROM g WHERE i = j UNION ALL SELECT t, i, j, 3 FROM g WHERE NOT (pj = i OR pi = j OR i = j))"""


@query(with_views("tree_set", PER_SQL + " SELECT t, i, j, rel, 1.0::DOUBLE AS p FROM per"))
def per_tensor(spark: SparkSession, d: str) -> DataFrame:
    return M.relations(S.tree_set(spark, d), ["t"])


@query(
    with_views(
        "cells mut_cells tree_set",
        F_HAT_SQL + TREE_LLH_SQL + W_SQL + PER_SQL + """, mem AS (SELECT DISTINCT mut, node FROM mut_cells),
w0 AS (SELECT method, tree, exp(llh + ln(count) - max(llh + ln(count)) OVER (PARTITION BY method)) AS e FROM m), w AS (SELECT method, tree, e / sum(e) OVER (PARTITION BY method) AS w FROM w0),
cp AS (SELECT method, i, j, rel, sum(w) AS p FROM per JOIN w ON w.tree = per.t GROUP BY ALL),
pp AS (SELECT method, a.mut AS a, b.mut AS b, rel, p FROM cp JOIN mem a ON a.node = i JOIN mem b ON b.node = j),
tp AS (SELECT a.mut AS a, b.mut AS b, rel, 1.0 AS q FROM per JOIN mem a ON a.node = i JOIN mem b ON b.node = j WHERE t = 0),
k AS (SELECT DISTINCT method, a, b, rel FROM (SELECT method, a, b, rel FROM pp UNION SELECT method, a, b, rel FROM tp, (SELECT DISTINCT method FROM m))),
z AS (SELECT method, a, b, rel, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS h FROM k LEFT JOIN pp USING (method, a, b, rel) LEFT JOIN tp USING (a, b, rel)),
js AS (SELECT method, a, b, least(1.0, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(p / h) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / h) ELSE 0 END))) AS jsd FROM z GROUP BY ALL),
o AS (SELECT mut, row_number() OVER (ORDER BY mut) AS pl FROM mem)
SELECT method, round(sum(jsd) / (0.5 * (SELECT count(*) FROM o) * ((SELECT count(*) FROM o) - 1)), 6) + 0.0 AS score
FROM js JOIN o oa ON oa.mut = a JOIN o ob ON ob.mut = b WHERE ob.pl <= oa.pl + 1 GROUP BY method""",
    )
)
def rrl(spark: SparkSession, d: str) -> DataFrame:
    """Relationship loss of two methods against the branching tree as the truth."""
    edges, members = S.tree_set(spark, d), _members(spark, d)
    named = edges.select((F.col("t") % 2).cast("string").alias("method"), F.col("t").alias("tree"), "node", "parent")
    truth = edges.where("t = 0").select(F.lit("truth").alias("method"), F.lit(0).alias("tree"), "node", "parent")
    one = truth.select("method", "tree", F.lit(0.0).alias("llh"), F.lit(1).alias("count")).distinct()
    q = M.clone_relation_probs(one, truth).select("i", "j", "rel", F.col("p").alias("q"))
    return M.clone_relation_loss(M.clone_relation_probs(_sampled_trees(spark, d), named), q, members, members).withColumn("score", r6("score"))


@query(with_views("vectors", ", c AS (SELECT label, unnest(range(1, 65)) AS i, x FROM vectors), m AS (SELECT label, i, avg(x[i]) AS x FROM c GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.x - b.x) ** 2)), 6) + 0.0 AS dist FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL"))
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Euclidean distances of the labels' mean vectors."""
    rows = S.embeddings(spark, d).select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return C.pairwise_distance(mean, id_col="label").withColumn("dist", r6("dist"))


VEC_SQL = ", fv AS (SELECT mut AS id, node AS cluster, sample, least(1.0, v / (omega * n)) AS f FROM mut_cells)"
PD_SQL = ", pd AS (SELECT a.id AS a, b.id AS b, a.cluster AS ca, b.cluster AS cb, sqrt(sum((a.f - b.f) ** 2)) AS dist FROM fv a JOIN fv b ON a.sample = b.sample AND a.id < b.id GROUP BY ALL)"


def _mut_freq(spark: SparkSession, d: str) -> DataFrame:
    return S.mut_cells(spark, d).select(F.col("mut").alias("id"), F.col("node").alias("cluster"), "sample", F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n"))).alias("f"))


def _mut_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _mut_freq(spark, d)
    a = rows.select(F.col("id").alias("a"), "sample", F.col("f").alias("fa"))
    b = rows.select(F.col("id").alias("b"), "sample", F.col("f").alias("fb"))
    pairs = a.join(b, "sample").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("fa") - F.col("fb"), 2))).alias("dist"))
    return pairs, rows.select("id", "cluster").distinct()


@query(with_views("mut_cells", VEC_SQL + PD_SQL + " SELECT least(ca, cb) AS c1, greatest(ca, cb) AS c2, round(min(dist), 6) + 0.0 AS dist FROM pd WHERE ca <> cb GROUP BY ALL"))
def min_linkage(spark: SparkSession, d: str) -> DataFrame:
    return C.linkage(*_mut_pairs(spark, d), "min").withColumn("dist", r6("dist"))


@query(with_views("mut_cells", VEC_SQL + PD_SQL + " SELECT least(ca, cb) AS c1, greatest(ca, cb) AS c2, round(avg(dist), 6) + 0.0 AS dist FROM pd WHERE ca <> cb GROUP BY 1, 2"))
def avg_linkage(spark: SparkSession, d: str) -> DataFrame:
    return C.linkage(*_mut_pairs(spark, d), "avg").withColumn("dist", r6("dist"))


@query(
    with_views(
        "mut_cells",
        VEC_SQL + """, m AS (SELECT cluster, sample, avg(least(greatest(f, 1e-4), 1 - 1e-4)) AS m, count(*) AS n FROM fv GROUP BY ALL)
SELECT a.cluster AS c1, b.cluster AS c2, round(sum(a.n * b.n / (a.n + b.n) * (a.m - b.m) ** 2), 6) + 0.0 AS dist FROM m a JOIN m b ON a.sample = b.sample AND a.cluster < b.cluster GROUP BY ALL""",
    )
)
def ward_linkage(spark: SparkSession, d: str) -> DataFrame:
    return C.ward(_mut_freq(spark, d)).withColumn("dist", r6("dist"))


CLUSTER_LLH_SQL = """, r AS (SELECT {c} AS cluster, sample, least(v, 2 * n * omega) + 1 AS v, 2 * n * omega + 2 AS n, least(greatest(least(1.0, v / (omega * n)), 1e-4), 1 - 1e-4) AS f FROM {t}),
pc AS (SELECT cluster, sample, sum(0.5 * f * n) / sum(n) AS p FROM r GROUP BY ALL),
cl AS (SELECT cluster, sum(""" + PMF_SQL + """) AS llh FROM r JOIN pc USING (cluster, sample) GROUP BY cluster)"""


@query(with_views("mut_cells", CLUSTER_LLH_SQL.format(c="node", t="mut_cells") + " SELECT cluster, round(llh, 6) + 0.0 AS llh FROM cl"))
def cluster_llh(spark: SparkSession, d: str) -> DataFrame:
    rows = S.mut_cells(spark, d).withColumn("f", F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n")))).withColumnRenamed("node", "cluster")
    return R.cluster_llh(rows).withColumn("llh", r6("llh"))


@query(
    with_views(
        "mut_cells",
        "".join(
            f", s{k} AS (WITH x AS (SELECT * FROM mut_cells)"
            + CLUSTER_LLH_SQL.format(c=f"CAST(floor((node - 1) / {k}) AS INT)", t="x")
            + f" SELECT {k} AS tree, count(*) AS size, sum(llh) AS llh FROM cl)"
            for k in (1, 2, 5, 25)
        )
        + """, a AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s5 UNION ALL SELECT * FROM s25),
b AS (SELECT size, llh, 2.0 * size * (SELECT count(DISTINCT sample) FROM mut_cells) * ln((SELECT count(DISTINCT mut) FROM mut_cells)) - 2 * llh AS criterion FROM a)
SELECT size, round(llh, 6) + 0.0 AS llh, round(criterion, 6) + 0.0 AS criterion FROM b ORDER BY criterion, size DESC LIMIT 1""",
    )
)
def model_select(spark: SparkSession, d: str) -> DataFrame:
    """The best by BIC of the clusterings of the mutations into 25, 13, 5 and 1 groups of neighbouring nodes."""
    rows = S.mut_cells(spark, d).withColumn("f", F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n"))))
    rows = rows.withColumn("by", F.explode(F.array(*map(F.lit, (1, 2, 5, 25)))))
    rows = rows.withColumn("cluster", F.struct("by", F.floor((F.col("node") - 1) / F.col("by")).alias("k")))
    every = R.cluster_llh(rows).groupBy(F.col("cluster.by").alias("by")).agg(F.count(F.lit(1)).alias("size"), F.sum("llh").alias("llh"))
    counts = S.mut_cells(spark, d).agg(F.count_distinct("mut").alias("n"), F.count_distinct("sample").alias("m")).withColumn("tree", F.lit(0))
    every = every.withColumn("tree", F.lit(0)).join(F.broadcast(counts), "tree")
    return C.select_clustering(every, F.col("n"), F.col("m")).select("size", r6("llh").alias("llh"), r6("criterion").alias("criterion"))


@query(with_views("mut_cells", ", k AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS c FROM (SELECT DISTINCT node FROM mut_cells)) SELECT DISTINCT 's' || mut AS id, CAST(c AS INT) AS clusters FROM mut_cells JOIN k USING (node)"))
def params_to_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The CSV rows of a clustering: id, clone number from 0."""
    packed = _members(spark, d).groupBy("node").agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), F.col("mut")))).alias("ids"))
    params = packed.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "ids"))), lambda s: s["ids"]).alias("clusters"))
    return C.assignment(params, keys=())


@query(
    with_views(
        "cells tree_heap",
        F_HAT_SQL + """, h AS (SELECT node, sample, f FROM f_hat WHERE node <> 0), t AS (SELECT node, sample, f / 2 AS f FROM h)
SELECT h.node, h.sample, round(100 * h.f, 6) + 0.0 AS data, round(100 * t.f, 6) + 0.0 AS tree, round(100 * abs(h.f - t.f), 6) + 0.0 AS error FROM h JOIN t USING (node, sample)""",
    )
)
def cp_table(spark: SparkSession, d: str) -> DataFrame:
    """The prevalence table for frequencies of half the implied ones."""
    c = S.cells(spark, d)
    half = R.f_hat(c).withColumn("f", F.col("f") / 2)
    return V.prevalence_table(c, half).select("node", "sample", r6("data").alias("data"), r6("tree").alias("tree"), r6("error").alias("error"))


@query(
    with_views(
        "cells tree_heap",
        F_HAT_SQL + """, b AS (SELECT e.parent AS node, sample, sum(f) AS b FROM tree_heap e JOIN f_hat USING (node) GROUP BY ALL)
SELECT f.sample, f.node, round(100 * (f.f - coalesce(b.b, 0.0)), 6) + 0.0 AS percent FROM f_hat f LEFT JOIN b USING (node, sample)""",
    )
)
def sp_table(spark: SparkSession, d: str) -> DataFrame:
    return V.subpopulation_table(S.tree_heap(spark, d), R.f_hat(S.cells(spark, d))).withColumn("percent", r6("percent"))


@query(
    with_views(
        "actions",
        """ SELECT branch, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(max(value), 6) + 0.0 AS max, round(min(value), 6) + 0.0 AS min,
  round(quantile_cont(value, 0.25), 6) + 0.0 AS p25, round(quantile_cont(value, 0.75), 6) + 0.0 AS p75 FROM actions GROUP BY branch""",
    )
)
def action_stats(spark: SparkSession, d: str) -> DataFrame:
    rows, v = S.actions(spark, d), F.col("value")
    shares = exact_quantiles(rows, ["branch"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    plain = rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.max(v)).alias("max"), r6(F.min(v)).alias("min"))
    return plain.join(shares, "branch").select("branch", "n", "mean", r6("median").alias("median"), "max", "min", r6("p25").alias("p25"), r6("p75").alias("p75"))


@query(
    with_views(
        "actions",
        """, g AS (SELECT branch, i, value / 50 AS phi, -ln(-ln((CAST('0x' || substr(md5('7|' || branch || '|' || i), 1, 13) AS BIGINT) + 0.5) / pow(2, 52))) AS e FROM actions),
h AS (SELECT branch, i, phi + e AS g, max(phi + e) OVER (PARTITION BY branch) AS z FROM g),
s AS (SELECT branch, i, CASE WHEN g >= z THEN 0.0 ELSE -greatest(-g + ln(1 - exp(g - z)), 0.0) - ln(1 + exp(-abs(-g + ln(1 - exp(g - z))))) END AS shifted FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY shifted DESC, i) AS rank FROM s)
SELECT branch, i, round(shifted, 6) + 0.0 AS shifted, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    )
)
def gumbel_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stochastic cut: five actions of each branch by noise conditioned on a largest value of 0."""
    key = F.concat_ws("|", F.lit("7"), F.col("branch").cast("string"), F.col("i").cast("string"))
    rows = S.actions(spark, d).withColumn("g", F.col("value") / 50 + gumbel(key_uniform(key)))
    # Five of each part of a branch, then of the branch: no task sorts a branch.
    parts = Window.partitionBy("branch", "part").orderBy(F.desc("g"), "i")
    few = rows.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(256))).withColumn("nth", F.row_number().over(parts)).where("nth <= 5")
    over = Window.partitionBy("branch")
    few = few.withColumn("shifted", gumbel_with_maximum(F.col("g"), F.lit(0.0), F.max("g").over(over)))
    few = few.withColumn("rank", F.row_number().over(over.orderBy(F.desc("shifted"), "i"))).where("rank <= 5")
    return few.select("branch", "i", r6("shifted").alias("shifted"), "rank")


def _half_placed(spark: SparkSession, d: str) -> DataFrame:
    """One partial tree for each node u above 12: the heap's nodes 1..12 placed, with data and frequencies as the fit gives them.

    Frequencies are the implied ones, eta what the children leave of them (0 at least).
    """
    c = S.cells(spark, d)
    edges, freq = S.tree_heap(spark, d).where("node <= 12"), R.f_hat(c)
    eta = T.eta_from_f(edges, freq).select("node", "sample", F.greatest("eta", F.lit(0.0)).alias("eta"))
    x = freq.join(eta, ["node", "sample"]).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("node", "f", "eta"))).alias("x"))
    fit = x.select(F.struct("sample", F.transform("x", lambda y: y["f"]).alias("f"), F.transform("x", lambda y: y["eta"]).alias("eta")).alias("fit"))
    fits = fit.groupBy().agg(F.array_sort(F.collect_list("fit")).alias("fits")).select("fits", F.lit(1).alias("_one"))
    u = S.tree_heap(spark, d).withColumn("parent", F.when(F.col("node") <= 12, F.col("parent")).otherwise(-1))
    tree = T.parents_of(u).select("parents", F.lit(1).alias("_one"))
    both = pack(c).select("samples", F.lit(1).alias("_one")).join(F.broadcast(fits), "_one").join(F.broadcast(tree), "_one").drop("_one")
    return both.withColumn("u", F.explode(F.filter(F.transform("parents", lambda p, i: F.when(p < 0, i + 1).otherwise(0)), lambda x: x > 0)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return P.scores(P.candidates(_half_placed(spark, d))).select("u", "v", "c", "model", "score")


PLACE_SQL = """, et AS (SELECT f.node, f.sample, greatest(f.f - coalesce(b.b, 0.0), 0.0) AS eta FROM f_hat f
  LEFT JOIN (SELECT e.parent AS node, sample, sum(f) AS b FROM tree_heap e JOIN f_hat USING (node) WHERE node <= 12 GROUP BY ALL) b USING (node, sample)),
ch AS (SELECT node AS v, coalesce((SELECT list_sort(list(k.node)) FROM tree_heap k WHERE k.node <= 12 AND k.parent = q.node), []) AS ch FROM (SELECT 0 AS node UNION SELECT node FROM nodes WHERE node <= 12) q),
ca AS (SELECT u.node AS u, v, ch, CAST([] AS INT[]) AS c, 2 AS model FROM nodes u, ch WHERE u.node > 12
  UNION ALL SELECT u, v, ch, list_filter(ch, lambda x, i: (mask >> (i - 1)) & 1 = 1), 1 FROM (SELECT u.node AS u, v, ch, unnest(range(1, CAST(pow(2, len(ch)) AS BIGINT))) AS mask FROM nodes u, ch WHERE u.node > 12)),
cs AS (SELECT ca.u, ca.v, ca.c, ca.model, cu.sample, cu.v AS vu, cu.n AS nu, cu.omega AS ou, CASE WHEN ca.v = 0 THEN 4 ELSE cv.v END AS vv, cv.n AS nv, CASE WHEN ca.v = 0 THEN 1e-3 ELSE cv.omega END AS ov,
  fv.f AS fv, ev.eta AS eta,
  coalesce((SELECT sum(f) FROM f_hat z WHERE z.sample = cu.sample AND list_contains(ca.ch, z.node) AND NOT list_contains(ca.c, z.node)), 0.0) AS stay,
  (SELECT sum(f) FROM f_hat z WHERE z.sample = cu.sample AND list_contains(ca.c, z.node)) AS fc,
  (SELECT sum(z.v) FROM cells z WHERE z.sample = cu.sample AND list_contains(ca.c, z.node)) AS vc0,
  (SELECT floor(sum(2 * z.n * z.omega)) FROM cells z WHERE z.sample = cu.sample AND list_contains(ca.c, z.node)) AS nc
  FROM ca JOIN cells cu ON cu.node = ca.u LEFT JOIN cells cv ON cv.node = ca.v AND cv.sample = cu.sample JOIN f_hat fv ON fv.node = ca.v AND fv.sample = cu.sample JOIN et ev ON ev.node = ca.v AND ev.sample = cu.sample),
c2 AS (SELECT *, CASE WHEN model = 1 THEN fv - stay ELSE eta END AS x, least(vc0, nc) AS vc FROM cs),
c3 AS (SELECT *, vu > 3 AND vv <= 3 AS par_v, NOT (vu <= 3 OR ou < 1e-3 OR ov < 1e-3 OR (vu > 3 AND vv <= 3)) AS val_v, vu > 3 AND vc <= 3 AS par_c, NOT (vu <= 3 OR ou < 1e-3 OR (vu > 3 AND vc <= 3)) AS val_c,
  least(1.0, greatest(0.0, ou * CASE WHEN v = 0 THEN x ELSE least(1 - exp(-30), x + 2.576 * sqrt(greatest(exp(-30), CASE WHEN nv = 0 THEN 0 ELSE x * (1 - x) / nv END))) END)) AS hi,
  least(1.0, greatest(0.0, ou * greatest(exp(-30), fc - 2.576 * sqrt(greatest(exp(-30), CASE WHEN nc = 0 THEN 0 ELSE fc * (1 - fc) / nc END))))) AS lo FROM c2),
c4 AS (SELECT *, CASE WHEN hi <= 0 THEN 0.0 WHEN hi >= 1 THEN 1.0 ELSE list_sum(list_transform(range(vu + 1, nu + 2), lambda j: exp(lgamma(nu + 2.0) - lgamma(j + 1.0) - lgamma(nu - j + 2.0) + j * ln(hi) + (nu + 1 - j) * ln(1 - hi)))) END AS tv,
  CASE WHEN lo IS NULL THEN NULL WHEN lo <= 0 THEN 0.0 WHEN lo >= 1 THEN 1.0 ELSE list_sum(list_transform(range(vu + 1, nu + 2), lambda j: exp(lgamma(nu + 2.0) - lgamma(j + 1.0) - lgamma(nu - j + 2.0) + j * ln(lo) + (nu + 1 - j) * ln(1 - lo)))) END AS tc,
  max(val_v) OVER (PARTITION BY u, v, c, model) AS any_v, max(val_c) OVER (PARTITION BY u, v, c, model) AS any_c FROM c3),
sc AS (SELECT u, v, c, model, sum(ln(greatest(exp(-30), CASE WHEN NOT any_v THEN exp(-30) WHEN val_v THEN tv WHEN par_v THEN exp(-30) ELSE 1 - exp(-30) END
  - CASE WHEN model = 2 THEN 0.0 WHEN NOT any_c THEN exp(-30) WHEN val_c THEN tc WHEN par_c THEN exp(-30) ELSE 1 - exp(-30) END))) AS score FROM c4 GROUP BY ALL)"""


@query(with_views("cells tree_heap", F_HAT_SQL + PLACE_SQL + " SELECT u, v, round(score, 4) + 0.0 AS score FROM sc WHERE model = 2"))
def placement_leaf(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("model") == P.LEAF).select("u", "v", (F.round("score", 4) + 0.0).alias("score"))


@query(with_views("cells tree_heap", F_HAT_SQL + PLACE_SQL + " SELECT u, v, c, round(score, 4) + 0.0 AS score FROM sc WHERE model = 1"))
def placement_split(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("model") == P.SPLIT).select("u", "v", "c", (F.round("score", 4) + 0.0).alias("score"))


@query(
    with_views(
        "cells tree_heap",
        F_HAT_SQL + PLACE_SQL + """, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY u)) AS e FROM sc), p AS (SELECT *, e / sum(e) OVER (PARTITION BY u) AS prob FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(prob, 12) DESC, v, model, c) - 1 AS i FROM p)
SELECT u, CAST(i AS INT) AS i, round(prob, 6) + 0.0 AS prob FROM r WHERE i < 5""",
    )
)
def placement_topf(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest placements of each node."""
    return P.best(_scored(spark, d), ["u"], 5).select("u", "i", r6("prob").alias("prob"))


@query(
    with_views(
        "cells tree_set",
        PARENTS_SQL + " SELECT DISTINCT parents, true AS root_is_one, true AS sums_fit, true AS etas_sum_to_one, true AS no_worse_than_zero_tree FROM pv",
    )
)
def fit_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """The distinct trees fitted: do the fits keep all constraints, and beat the feasible star of equal shares?"""
    c = S.cells(spark, d)
    trees = T.parents_of(S.tree_set(spark, d), ["t"]).select("parents").distinct()
    fitted = fit_trees(trees, pack(c))
    freq = frequencies(fitted, ["parents"])
    root = freq.where("node = 0").groupBy("parents").agg(F.bool_and(F.abs(F.col("f") - 1) < 1e-9).alias("root_is_one"))
    eta = freq.groupBy("parents", "sample").agg(F.sum("eta").alias("s"), F.min("eta").alias("low")).groupBy("parents").agg(F.bool_and((F.abs(F.col("s") - 1) < 1e-6) & (F.col("low") >= 0)).alias("etas_sum_to_one"))
    edges = T.edges_of(trees, keys=["parents"])
    below = edges.join(freq, ["parents", "node"]).groupBy("parents", F.col("parent").alias("node"), "sample").agg(F.sum("f").alias("b"))
    fits = below.join(freq, ["parents", "node", "sample"]).groupBy("parents").agg(F.bool_and(F.col("b") <= F.col("f") + 1e-9).alias("sums_fit"))
    data = R.f_hat(c).withColumnRenamed("f", "hat").join(R.var_weights(c), ["node", "sample"])
    cost = freq.join(data, ["node", "sample"]).groupBy("parents").agg((F.sum(F.pow(F.col("hat") - F.col("f"), 2) / F.col("w")) <= F.sum(F.pow(F.col("hat"), 2) / F.col("w"))).alias("no_worse_than_zero_tree"))
    return root.join(fits, "parents").join(eta, "parents").join(cost, "parents")


@query()
def fitted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Fitted frequencies of the distinct trees: parents, node, sample, f, eta."""
    trees = T.parents_of(S.tree_set(spark, d), ["t"]).select("parents").distinct()
    return frequencies(fit_trees(trees, pack(S.cells(spark, d))), ["parents"])


@query()
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic beam search over all nodes."""
    return package(search(S.cells(spark, d), SearchParams(beam_width=2, branching_factor=10, expansion_factor=2, model="bs"))).drop("fits")


@query()
def stochastic_beam_search(spark: SparkSession, d: str) -> DataFrame:
    """Stochastic beam search, two instances with different node orders."""
    return package(search(S.cells(spark, d), SearchParams(beam_width=1, branching_factor=10, instances=2, seed=123, node_order="diverse"))).drop("fits")


def _clone_trees(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Clone trees of the fitted distinct trees, and the cells they are scored on."""
    c = S.cells(spark, d)
    trees = T.parents_of(S.tree_set(spark, d), ["t"]).groupBy("parents").agg(F.min("t").alias("tree"))
    freq = frequencies(fit_trees(trees, pack(c)), ["tree"]).where("node > 0")
    data = freq.join(c, ["node", "sample"]).select("tree", "node", "sample", "v", "n", "omega", "f")
    return C.clustering_llh(C.agglomerate(trees, freq, kind), data), c


@query()
def pac(spark: SparkSession, d: str) -> DataFrame:
    """Every clone tree of four trees, agglomerated by average linkage, with its log likelihood."""
    return _clone_trees(spark, d, "avg")[0].withColumn("llh", r6("llh"))


@query()
def clone_tree_refit(spark: SparkSession, d: str) -> DataFrame:
    """The clone tree that BIC selects for each tree (Ward linkage), its clones' reads pooled and its frequencies fitted again."""
    clusterings, c = _clone_trees(spark, d, "ward")
    counts = c.agg(F.count_distinct("node").alias("n"), F.count_distinct("sample").alias("m"), F.lit(1).alias("_one"))
    rows = clusterings.withColumn("_one", F.lit(1)).join(F.broadcast(counts), "_one")
    return V.refit(C.select_clustering(rows, F.col("n"), F.col("m")).drop("_one", "n", "m"), c)


@query(with_views("cells tree_set", F_HAT_SQL + TREE_LLH_SQL + ", s AS (SELECT CAST(t % 2 AS VARCHAR) AS method, max(llh) AS score FROM tl GROUP BY 1) SELECT method, CASE WHEN method = 'truth' THEN 0.0 ELSE coalesce(round(score, 6), -1.0) END + 0.0 AS score FROM (SELECT DISTINCT CAST(t % 3 AS VARCHAR) AS method FROM tree_set UNION ALL SELECT 'truth') LEFT JOIN s USING (method)"))
def method_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score table: a named method without results scores -1, the truth 0."""
    scored = _sampled_trees(spark, d).groupBy("method").agg(r6(F.max("llh")).alias("score"))
    names = S.tree_set(spark, d).select((F.col("t") % 3).cast("string").alias("method")).distinct()
    return M.method_scores(names.unionByName(names.select(F.lit("truth").alias("method")).distinct()), scored)


@query(with_views("cells tree_set", F_HAT_SQL + TREE_LLH_SQL + W_SQL + " SELECT method, tree, round(e / sum(e) OVER (PARTITION BY method), 6) + 0.0 AS w FROM (SELECT method, tree, exp(llh + ln(count) - max(llh + ln(count)) OVER (PARTITION BY method)) AS e FROM m)"))
def tree_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.tree_weights(_sampled_trees(spark, d), True).withColumn("w", r6("w"))


@query(with_views("actions", " SELECT branch, i, round(e / sum(e) OVER (PARTITION BY branch), 8) + 0.0 AS prob FROM (SELECT branch, i, exp(value / 100 - max(value / 100) OVER (PARTITION BY branch)) AS e FROM actions)"))
def action_probs(spark: SparkSession, d: str) -> DataFrame:
    rows, x = S.actions(spark, d), F.col("value") / 100
    top = rows.groupBy("branch").agg(F.max(x).alias("top"))  # partial maxima and sums: no task holds a branch
    total = rows.join(top, "branch").groupBy("branch").agg(F.max("top").alias("top"), F.sum(F.exp(x - F.col("top"))).alias("total"))
    return rows.join(total, "branch").select("branch", "i", (F.round(F.exp(x - F.col("top")) / F.col("total"), 8) + 0.0).alias("prob"))


@query(with_views("cells tree_set", F_HAT_SQL + TREE_LLH_SQL + " SELECT t, round(-llh / ((SELECT count(DISTINCT node) FROM cells) * (SELECT count(DISTINCT sample) FROM cells) * ln(2)), 6) + 0.0 AS score FROM tl"))
def plot_score(spark: SparkSession, d: str) -> DataFrame:
    """The score of each tree that plots show."""
    size = S.cells(spark, d).agg(F.count_distinct("node").alias("nodes"), F.count_distinct("sample").alias("samples"), F.lit(1).alias("_one"))
    rows = tree_likelihoods(spark, d).withColumn("_one", F.lit(1)).join(size, "_one")
    return rows.select("t", r6(M.plot_score(F.col("llh"), F.col("nodes"), F.col("samples"))).alias("score"))


def _grouped_cells(spark: SparkSession, d: str, groups: int) -> DataFrame:
    c = S.cells(spark, d).withColumn("node", (1 + (F.col("node") - 1) % groups).cast("int"))
    return c.groupBy("node", "sample").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).withColumn("omega", F.lit(0.5))


@query(
    """WITH l AS (SELECT 4 AS run, [a, b, c, d] AS p FROM range(0, 5) r1(a), range(0, 5) r2(b), range(0, 5) r3(c), range(0, 5) r4(d)
  UNION ALL SELECT 3, [a, b, c] FROM range(0, 4) r1(a), range(0, 4) r2(b), range(0, 4) r3(c)),
s1 AS (SELECT run, p, unnest(p) AS a FROM l), s2 AS (SELECT run, p, CASE WHEN a = 0 THEN 0 ELSE p[a] END AS a FROM s1),
s3 AS (SELECT run, p, CASE WHEN a = 0 THEN 0 ELSE p[a] END AS a FROM s2), s4 AS (SELECT run, p, CASE WHEN a = 0 THEN 0 ELSE p[a] END AS a FROM s3)
SELECT run, list_transform(p, lambda i: CAST(i AS INT)) AS parents, (SELECT sum(CAST(pow(j + 1, j - 1) AS BIGINT))::BIGINT FROM range(0, run) t(j)) AS explored, 0::BIGINT AS cut
FROM s4 GROUP BY run, p HAVING max(a) = 0"""
)
def search_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs, of three and of four groups of nodes, searched together with a beam wide enough for all their trees: each is
    found once, by way of all smaller trees."""
    wide = SearchParams(beam_width=200, branching_factor=200, expansion_factor=200, model="bs")
    both = _grouped_cells(spark, d, 3).withColumn("run", F.lit(3)).unionByName(_grouped_cells(spark, d, 4).withColumn("run", F.lit(4)))
    return search(both, wide).select("run", "parents", "explored", "cut")


@query(
    with_views(
        "cells",
        """, h AS (SELECT node AS i, sample, least(1.0, v / (omega * n)) AS t, 1 / greatest(1e-4, (v + 1.0) * (1.0 - (v + 1.0) / (n + 2.0)) / pow((n + 2.0) * omega, 2)) AS k FROM cells),
b AS (SELECT x.sample, x.i, x.t, x.k, sum(y.t) AS st, sum(1 / y.k) AS sw FROM h x JOIN h y ON x.sample = y.sample AND (y.t * y.k > x.t * x.k OR (y.t * y.k = x.t * x.k AND y.i <= x.i)) GROUP BY ALL),
m AS (SELECT sample, greatest(0, max((st - 1) / sw)) AS mu FROM b GROUP BY sample),
star AS (SELECT 'star' AS tree, i AS node, sample, greatest(0, t - mu / k) AS f FROM h JOIN m USING (sample)),
c AS (SELECT x.sample, x.i AS a, y.i AS b, (SELECT sum(z.t * z.k) / sum(z.k) FROM h z WHERE z.sample = x.sample AND z.i BETWEEN x.i AND y.i) AS m FROM h x JOIN h y ON x.sample = y.sample AND x.i <= y.i),
u AS (SELECT c.sample, h.i, c.a, max(c.m) AS m FROM h JOIN c ON h.sample = c.sample AND c.a <= h.i AND c.b >= h.i GROUP BY ALL),
chain AS (SELECT 'chain' AS tree, i AS node, sample, least(1.0, greatest(0.0, min(m))) AS f FROM u GROUP BY ALL)
SELECT tree, node, sample, round(f, 6) + 0.0 AS f FROM (SELECT * FROM star UNION ALL SELECT * FROM chain)""",
    )
)
def fit_star_chain(spark: SparkSession, d: str) -> DataFrame:
    """The fits of all nodes as one star and as one chain, which have closed forms: a projection onto a simplex, and isotonic
    regression."""
    c = S.cells(spark, d)
    kinds = F.explode(F.array(F.struct(F.lit("star").alias("tree"), F.lit(0).alias("parent")), F.struct(F.lit("chain").alias("tree"), (F.col("node") - 1).alias("parent"))))
    edges = c.select("node").distinct().select("node", kinds.alias("k")).select("k.tree", "node", "k.parent")
    freq = frequencies(fit_trees(T.parents_of(edges, ["tree"]), pack(c)), ["tree"])
    return freq.where("node > 0").select("tree", "node", "sample", r6("f").alias("f"))


@query(
    with_views(
        "cells",
        """, q AS (SELECT 1 + (node - 1) % 3 AS node, sample, sum(v) AS v, sum(n) AS n, 0.5 AS omega FROM cells GROUP BY ALL),
ds AS (SELECT a.node AS a, b.node AS b, round(sqrt(sum((least(1.0, a.v / (a.omega * a.n)) - least(1.0, b.v / (b.omega * b.n))) ** 2)), 12) AS dist FROM q a JOIN q b ON a.sample = b.sample AND a.node < b.node GROUP BY ALL),
k AS (SELECT a, b FROM ds ORDER BY dist, a, b LIMIT 1),
g AS (SELECT 3 AS size, i AS node, i AS clone FROM range(1, 4) t(i) UNION ALL SELECT 2, i, CASE WHEN i = b THEN a ELSE i END FROM range(1, 4) t(i), k UNION ALL SELECT 1, i, 1 FROM range(1, 4) t(i)),
r AS (SELECT size, clone AS cluster, sample, least(v, 2 * n * omega) + 1 AS v, 2 * n * omega + 2 AS n, least(greatest(least(1.0, v / (omega * n)), 1e-4), 1 - 1e-4) AS f FROM g JOIN q USING (node)),
pc AS (SELECT size, cluster, sample, sum(0.5 * f * n) / sum(n) AS p FROM r GROUP BY ALL),
ll AS (SELECT size, sum(""" + PMF_SQL + """) AS llh FROM r JOIN pc USING (size, cluster, sample) GROUP BY size),
cl AS (SELECT size, list(own ORDER BY clone) AS clusters FROM (SELECT size, clone, list(CAST(node AS INT) ORDER BY node) AS own FROM g GROUP BY ALL) GROUP BY size),
pa AS (SELECT size, list(CASE WHEN node = clone THEN 0 ELSE -1 END ORDER BY node) AS parents FROM g GROUP BY size)
SELECT size, parents, clusters, round(llh, 6) + 0.0 AS llh FROM cl JOIN pa USING (size) JOIN ll USING (size)""",
    )
)
def pac_star(spark: SparkSession, d: str) -> DataFrame:
    """Every clone tree of a star of three groups of nodes, by average linkage of their implied frequencies."""
    c = _grouped_cells(spark, d, 3)
    star = T.parents_of(c.select("node").distinct().withColumn("parent", F.lit(0))).withColumn("tree", F.lit(0))
    data = c.withColumns({"tree": F.lit(0), "f": F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n")))})
    rows = C.clustering_llh(C.agglomerate(star, data.select("tree", "node", "sample", "f"), "avg"), data)
    return rows.select("size", "parents", "clusters", r6("llh").alias("llh"))


METRIC_SQL = """, c AS (SELECT label, unnest(range(1, 65)) AS i, x FROM vectors), m AS (SELECT label, i, avg(x[i]) AS x FROM c GROUP BY ALL),
z AS (SELECT label, i, x, x - avg(x) OVER (PARTITION BY label) AS y FROM m),
p AS (SELECT a.label AS a, b.label AS b, sum(abs(a.x - b.x)) AS cityblock, max(abs(a.x - b.x)) AS chebyshev, sum((a.x - b.x) ** 2) AS sqeuclidean,
  sum(CASE WHEN a.x = 0 AND b.x = 0 THEN 0 ELSE abs(a.x - b.x) / (abs(a.x) + abs(b.x)) END) AS canberra, sum(abs(a.x - b.x)) / sum(abs(a.x + b.x)) AS braycurtis,
  1 - sum(a.x * b.x) / sqrt(sum(a.x ** 2) * sum(b.x ** 2)) AS cosine, 1 - sum(a.y * b.y) / sqrt(sum(a.y ** 2) * sum(b.y ** 2)) AS correlation, avg(CASE WHEN a.x <> b.x THEN 1.0 ELSE 0.0 END) AS hamming
  FROM z a JOIN z b ON a.i = b.i AND a.label < b.label GROUP BY ALL)
SELECT a, b, """ + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in C.METRICS if m != "euclidean") + " FROM p"


@query(with_views("vectors", METRIC_SQL))
def pairwise_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All distances but the Euclidean one of the labels' mean vectors."""
    rows = S.embeddings(spark, d).select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    pairs = mean.select(F.col("label").alias("a"), F.col("x").alias("xa")).join(mean.select(F.col("label").alias("b"), F.col("x").alias("xb")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", *[r6(C.distance(F.col("xa"), F.col("xb"), m)).alias(m) for m in C.METRICS if m != "euclidean"])


#: Two linear segments below the root: 2 under 1, 4 under 3.
SEGMENTS = (0, 1, 0, 3)


@query(
    with_views(
        "cells",
        """, q AS (SELECT 1 + (node - 1) % 4 AS node, sample, sum(v) AS v, sum(n) AS n, 0.5 AS omega FROM cells GROUP BY ALL),
ds AS (SELECT a.node AS a, b.node AS b, round(sqrt(sum((least(1.0, a.v / (a.omega * a.n)) - least(1.0, b.v / (b.omega * b.n))) ** 2)), 12) AS dist FROM q a JOIN q b ON a.sample = b.sample AND a.node < b.node GROUP BY ALL),
k AS (SELECT (SELECT dist FROM ds WHERE a = 1 AND b = 2) <= (SELECT dist FROM ds WHERE a = 3 AND b = 4) AS left_first),
g AS (SELECT 4 AS size, i AS node, i AS clone FROM range(1, 5) t(i) UNION ALL SELECT 3, i, CASE WHEN left_first AND i = 1 THEN 2 WHEN NOT left_first AND i = 3 THEN 4 ELSE i END FROM range(1, 5) t(i), k
  UNION ALL SELECT 2, i, CASE WHEN i < 3 THEN 2 ELSE 4 END FROM range(1, 5) t(i) UNION ALL SELECT 1, i, 2 FROM range(1, 5) t(i)),
up AS (SELECT * FROM (VALUES (1, 0), (2, 1), (3, 0), (4, 3)) t(node, parent)),
r AS (SELECT size, clone AS cluster, sample, least(v, 2 * n * omega) + 1 AS v, 2 * n * omega + 2 AS n, least(greatest(least(1.0, v / (omega * n)), 1e-4), 1 - 1e-4) AS f FROM g JOIN q USING (node)),
pc AS (SELECT size, cluster, sample, sum(0.5 * f * n) / sum(n) AS p FROM r GROUP BY ALL),
ll AS (SELECT size, sum(""" + PMF_SQL + """) AS llh FROM r JOIN pc USING (size, cluster, sample) GROUP BY size),
cl AS (SELECT size, list(own ORDER BY clone) AS clusters FROM (SELECT size, clone, list(CAST(node AS INT) ORDER BY node) AS own FROM g GROUP BY ALL) GROUP BY size),
pa AS (SELECT size, list(CASE WHEN clone <> node THEN -1 WHEN parent > 0 AND EXISTS (SELECT 1 FROM g h WHERE h.size = g.size AND h.node = up.parent AND h.clone = h.node) THEN parent ELSE 0 END ORDER BY node) AS parents FROM g JOIN up USING (node) GROUP BY size)
SELECT size, parents, clusters, round(llh, 6) + 0.0 AS llh FROM cl JOIN pa USING (size) JOIN ll USING (size)""",
    )
)
def pac_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every clone tree of two linear segments of two groups of nodes each: the segments merge first, the closer one before the
    other, then across branches."""
    c = _grouped_cells(spark, d, 4)
    start = c.groupBy().agg(F.lit(0).alias("tree")).select("tree", F.array(*map(F.lit, SEGMENTS)).alias("parents"))
    data = c.withColumns({"tree": F.lit(0), "f": F.least(F.lit(1.0), F.col("v") / (F.col("omega") * F.col("n")))})
    rows = C.clustering_llh(C.agglomerate(start, data.select("tree", "node", "sample", "f"), "avg"), data)
    return rows.select("size", "parents", "clusters", r6("llh").alias("llh"))
