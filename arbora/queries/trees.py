"""Tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import softmax
from arbora.operators import reads as R
from arbora.operators import trees as T
from arbora.operators.cluster import lineage_clusterings
from arbora.operators.enumerate import count_trees as count_all
from arbora.operators.enumerate import enumerate_trees as enumerate_all
from arbora.queries.reads import F_HAT_SQL, r6
from arbora.sources.formats import matrix_column, truth_trees
from arbora.sources.views import cells, nodes, tree_heap, tree_set, with_views

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ANC_SQL = """, a AS (SELECT node AS anc, node, 0 AS depth FROM e UNION ALL SELECT 0, 0, 0
  UNION ALL SELECT e.parent, a.node, a.depth + 1 FROM a JOIN e ON a.anc = e.node)"""


@query(with_views("tree_set", " SELECT t, node, parent FROM tree_set"))
def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parents vectors of all trees, and back to edges."""
    packed = T.parents_of(tree_set(spark, d), ["t"])
    return T.edges_of(packed, keys=["t"])


@query(
    with_views(
        "tree_set",
        """, a AS (SELECT t, node AS anc, node, 0 AS depth FROM tree_set UNION ALL SELECT DISTINCT t, 0, 0, 0 FROM tree_set
  UNION ALL SELECT a.t, e.parent, a.node, a.depth + 1 FROM a JOIN tree_set e ON a.t = e.t AND a.anc = e.node) SELECT t, anc, node, depth FROM a""",
        recursive=True,
    )
)
def ancestry(spark: SparkSession, d: str) -> DataFrame:
    return T.ancestry(tree_set(spark, d), ["t"])


@query(
    with_views(
        "tree_heap",
        """, p AS (SELECT node, CASE WHEN parent % 2 = 0 THEN parent ELSE CAST(floor(parent / 2) AS INT) END AS parent FROM tree_heap WHERE node % 2 = 0),
r AS (SELECT node, parent, CAST(dense_rank() OVER (ORDER BY node) AS INT) AS rank FROM p)
SELECT r.node, r.rank, coalesce(q.rank, 0) AS parent_rank FROM r LEFT JOIN r q ON r.parent = q.node""",
    )
)
def partial_parents(spark: SparkSession, d: str) -> DataFrame:
    """The even nodes of the heap, odd ones not placed; an odd parent gives way to its own parent."""
    p = F.col("parent")
    up = F.when(p % 2 == 0, p).otherwise(F.floor(p / 2).cast("int"))
    return T.partial_parents(tree_heap(spark, d).withColumn("parent", F.when(F.col("node") % 2 == 0, up).otherwise(-1)))


@query(
    with_views(
        "tree_set",
        """, k AS (SELECT t, 0 AS node, CAST(NULL AS INT) AS parent FROM tree_set UNION SELECT t, node, parent FROM tree_set),
w AS (SELECT t, node, [node] AS path, 0 AS depth FROM k WHERE node = 0 UNION ALL SELECT k.t, k.node, list_append(w.path, k.node), w.depth + 1 FROM w JOIN k ON k.t = w.t AND k.parent = w.node),
x AS (SELECT t, path, depth, node, EXISTS (SELECT 1 FROM k WHERE k.t = w.t AND k.parent = w.node) AS inner_node FROM w),
b AS (SELECT *, lead(depth) OVER (PARTITION BY t ORDER BY path) AS nd, lag(depth) OVER (PARTITION BY t ORDER BY path) AS pd, row_number() OVER (PARTITION BY t ORDER BY path) AS pos FROM x),
c AS (SELECT t, pos, (CASE WHEN pd >= depth THEN ',' ELSE '' END) || CASE WHEN inner_node THEN '('
  ELSE CAST(node AS VARCHAR) || array_to_string(list_transform(range(0, depth - coalesce(nd, 0)), lambda i: ')' || CAST(path[len(path) - i - 1] AS VARCHAR)), '') END AS piece FROM b)
SELECT t, string_agg(piece, '' ORDER BY pos) || ';' AS newick FROM c GROUP BY t""",
        recursive=True,
    )
)
def newick(spark: SparkSession, d: str) -> DataFrame:
    return T.newick(tree_set(spark, d), ["t"])


LINEAGE_SQL = """, s AS (SELECT t, parent, count(*) AS c FROM tree_set GROUP BY ALL),
h AS (SELECT t, node AS head, parent, node FROM tree_set JOIN s USING (t, parent) WHERE parent = 0 OR c > 1),
l AS (SELECT t, head, parent, node FROM h UNION ALL SELECT l.t, l.head, l.parent, e.node FROM l JOIN tree_set e ON e.t = l.t AND e.parent = l.node JOIN s ON s.t = e.t AND s.parent = e.parent WHERE s.c = 1)"""


@query(
    with_views(
        "tree_set",
        LINEAGE_SQL + " SELECT t, head, parent, list_sort(list(node)) AS nodes FROM l GROUP BY t, head, parent",
        recursive=True,
    )
)
def lineages(spark: SparkSession, d: str) -> DataFrame:
    return T.lineages(tree_set(spark, d), ["t"])


@query(
    with_views(
        "tree_set",
        LINEAGE_SQL
        + """, g AS (SELECT t, head, parent, list_sort(list(node)) AS nodes FROM l GROUP BY t, head, parent),
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY head) AS clone FROM g),
u AS (SELECT n.t, n.clone, n.nodes, CAST(coalesce(o.clone, 0) AS INT) AS up FROM n LEFT JOIN (SELECT t, clone, unnest(nodes) AS node FROM n) o ON o.t = n.t AND o.node = n.parent)
SELECT t, CAST(count(*) AS INT) AS size, 0.0::DOUBLE AS llh, list(up ORDER BY clone) AS parents, list(nodes ORDER BY clone) AS clusters FROM u GROUP BY t""",
        recursive=True,
    )
)
def lineage_clones(spark: SparkSession, d: str) -> DataFrame:
    """The clone tree of each tree whose clones are its lineages."""
    return lineage_clusterings(tree_set(spark, d), ["t"])


@query(with_views("tree_set", " SELECT t, node, CASE WHEN parent = 2 THEN (SELECT g.parent FROM tree_set g WHERE g.t = e.t AND g.node = 2) ELSE parent END AS parent FROM tree_set e WHERE node <> 2"))
def contract_edge(spark: SparkSession, d: str) -> DataFrame:
    """Node 2 merged into a child in every tree."""
    return T.contract(tree_set(spark, d), F.lit(2), ["t"])


@query(
    with_views(
        "cells tree_heap",
        F_HAT_SQL + """, b AS (SELECT e.parent AS node, sample, sum(f) AS b FROM tree_heap e JOIN f_hat USING (node) GROUP BY ALL)
SELECT f.node, f.sample, round(f.f - coalesce(b.b, 0.0), 6) + 0.0 AS eta FROM f_hat f LEFT JOIN b USING (node, sample)""",
    )
)
def eta_from_f(spark: SparkSession, d: str) -> DataFrame:
    return T.eta_from_f(tree_heap(spark, d), R.f_hat(cells(spark, d))).withColumn("eta", r6("eta"))


SHARE_SQL = ", eta AS (SELECT node, sample, n / sum(n) OVER (PARTITION BY sample) AS eta FROM cells UNION ALL SELECT DISTINCT 0, sample, 0.0 FROM cells)"


def shares(c: DataFrame) -> DataFrame:
    """node, sample, eta: each node's share of a sample's reads, none for the root."""
    own = c.select("node", "sample", (F.col("n") / F.sum("n").over(Window.partitionBy("sample"))).alias("eta"))
    return own.unionByName(c.select(F.lit(0).alias("node"), "sample", F.lit(0.0).alias("eta")).distinct())


@query(with_views("cells tree_heap", ", e AS (SELECT * FROM tree_heap)" + ANC_SQL + SHARE_SQL + " SELECT a.anc AS node, sample, round(sum(eta), 6) + 0.0 AS f FROM a JOIN eta USING (node) GROUP BY a.anc, sample", recursive=True))
def f_from_eta(spark: SparkSession, d: str) -> DataFrame:
    return T.f_from_eta(tree_heap(spark, d), shares(cells(spark, d))).withColumn("f", r6("f"))


@query(
    with_views(
        "cells tree_set",
        F_HAT_SQL + """, b AS (SELECT t, parent AS node, sample, sum(f) AS below FROM tree_set JOIN f_hat USING (node) GROUP BY ALL)
SELECT t, node, sample, round(f, 6) + 0.0 AS f, round(below, 6) + 0.0 AS below FROM b JOIN f_hat USING (node, sample) WHERE below > f + 1e-10""",
    )
)
def isa_violations(spark: SparkSession, d: str) -> DataFrame:
    trees = tree_set(spark, d)
    every = trees.select("t", "node").unionByName(trees.select("t", F.lit(0).alias("node")).distinct())
    freq = every.join(R.f_hat(cells(spark, d)), "node")
    return T.isa_violations(trees, freq, ["t"]).select("t", "node", "sample", r6("f").alias("f"), r6("below").alias("below"))


@query(with_views("cells", F_HAT_SQL + " SELECT a.node AS u, b.node AS v FROM f_hat a JOIN f_hat b ON a.sample = b.sample AND a.node <> b.node GROUP BY 1, 2 HAVING bool_and(a.f >= b.f)"))
def tau(spark: SparkSession, d: str) -> DataFrame:
    return T.dominance(R.f_hat(cells(spark, d)))


PARENTS_SQL = ", pv AS (SELECT t, list(parent ORDER BY node) AS parents FROM tree_set GROUP BY t)"


@query(with_views("tree_set", PARENTS_SQL + " SELECT parents, count(*) AS count, min(t) AS first FROM pv GROUP BY parents"))
def tree_dedup(spark: SparkSession, d: str) -> DataFrame:
    return T.parents_of(tree_set(spark, d), ["t"]).groupBy("parents").agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first"))


@query(with_views("tree_set", PARENTS_SQL + " SELECT t, CAST(len(parents) - len(list_distinct(parents)) AS INT) AS parsimony FROM pv"))
def parsimony(spark: SparkSession, d: str) -> DataFrame:
    return T.parents_of(tree_set(spark, d), ["t"]).select("t", T.parsimony("parents").alias("parsimony"))


TREE_LLH_SQL = """, fx AS (SELECT t, node, sample, f / (1 + coalesce(nc, 0)) AS f FROM (SELECT DISTINCT t, node FROM tree_set) JOIN f_hat USING (node)
  LEFT JOIN (SELECT t, parent AS node, count(*) AS nc FROM tree_set GROUP BY ALL) USING (t, node)),
tl AS (SELECT t, sum(lgamma(n + 1.0) - lgamma(v + 1.0) - lgamma(n - v + 1.0) + v * ln(p) + (n - v) * ln(1.0 - p)) / 1000 AS llh
  FROM (SELECT t, v, n, least(greatest(omega * f, 1e-5), 1 - 1e-5) AS p FROM fx JOIN cells USING (node, sample)) GROUP BY t)"""


def tree_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """t, node, sample, f: a frequency for each tree of the set, the implied one shared with the node's children."""
    trees = tree_set(spark, d)
    kids = trees.groupBy("t", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("nc"))
    rows = trees.select("t", "node").join(kids, ["t", "node"], "left").join(R.f_hat(cells(spark, d)), "node")
    return rows.select("t", "node", "sample", (F.col("f") / (1 + F.coalesce("nc", F.lit(0)))).alias("f"))


def tree_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """t, llh: log likelihoods, in thousands so that their softmax has some spread."""
    c, freq = cells(spark, d), tree_frequencies(spark, d)
    return R.cell_llh(c, freq, ["t"]).groupBy("t").agg((F.sum("llh") / 1000).alias("llh"))


@query(with_views("cells tree_set", F_HAT_SQL + TREE_LLH_SQL + " SELECT t, round(llh, 6) + 0.0 AS llh, round(exp(llh - max(llh) OVER ()) / (SELECT sum(exp(llh - (SELECT max(llh) FROM tl))) FROM tl), 6) + 0.0 AS prob FROM tl"))
def posterior(spark: SparkSession, d: str) -> DataFrame:
    rows = tree_likelihoods(spark, d)
    return rows.select("t", r6("llh").alias("llh"), r6(softmax(F.col("llh"), Window.partitionBy(F.lit(1)))).alias("prob"))


@query(
    with_views(
        "tree_set",
        """ SELECT t, parent AS v, [node] AS c FROM tree_set
UNION ALL SELECT a.t, a.parent, [a.node, b.node] FROM tree_set a JOIN tree_set b ON a.t = b.t AND a.parent = b.parent AND a.node < b.node""",
    )
)
def powerset(spark: SparkSession, d: str) -> DataFrame:
    """Child sets of at most two members, over all nodes of all trees."""
    return T.child_sets(T.children(tree_set(spark, d), ["t"]), 2).select("t", F.col("parent").alias("v"), "c")


@query(
    with_views(
        "tree_set",
        PARENTS_SQL + """, a AS (SELECT t, parents, unnest(range(1, len(parents) + 1)) AS v, len(parents) + 1 AS u FROM pv)
SELECT t, v AS v, list_append(list_transform(parents, lambda p, i: CASE WHEN p = v AND i % 2 = 0 THEN u ELSE p END), v) AS parents FROM a""",
    )
)
def apply_actions(spark: SparkSession, d: str) -> DataFrame:
    """A new node put under every node of every tree, over that node's even children."""
    rows = T.parents_of(tree_set(spark, d), ["t"]).withColumn("parents", F.concat("parents", F.array(F.lit(-1))))
    n = F.size("parents")
    rows = rows.withColumn("v", F.explode(F.sequence(F.lit(1), n - 1)))
    c = F.filter(F.transform("parents", lambda p, i: F.when((p == F.col("v")) & ((i + 1) % 2 == 0), i + 1).otherwise(0)), lambda x: x > 0)
    return rows.select("t", F.col("v").cast("long").alias("v"), T.apply_action("parents", F.size("parents"), F.col("v"), c).alias("parents"))


GROUPS_SQL = (
    """WITH RECURSIVE g AS (SELECT 1 + (CAST(substr(p_brand, 7) AS INT) - 1) % 6 AS node, CAST(n_regionkey AS INT) AS sample, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
eta AS (SELECT node, sample, n / sum(n) OVER (PARTITION BY sample) AS eta FROM g UNION ALL SELECT DISTINCT 0, sample, 0.0 FROM g),
e AS (SELECT DISTINCT node, CAST(floor(node / 2) AS INT) AS parent FROM g)"""
    + ANC_SQL
    + ", f AS (SELECT a.anc AS node, sample, sum(eta) AS f FROM a JOIN eta USING (node) GROUP BY a.anc, sample)"
)
ENUMERATED_SQL = (
    GROUPS_SQL
    + """, o AS (SELECT node, row_number() OVER (ORDER BY round(sum(f), 12) DESC, node) - 1 AS place FROM f GROUP BY node),
q AS (SELECT c.node AS node, p.node AS parent FROM o c JOIN o p ON p.place < c.place),
ps AS (SELECT q1.parent AS p1, q2.parent AS p2, q3.parent AS p3, q4.parent AS p4, q5.parent AS p5, q6.parent AS p6
  FROM q q1, q q2, q q3, q q4, q q5, q q6 WHERE q1.node = 1 AND q2.node = 2 AND q3.node = 3 AND q4.node = 4 AND q5.node = 5 AND q6.node = 6),
l AS (SELECT [p1, p2, p3, p4, p5, p6] AS parents FROM ps),
x AS (SELECT parents, unnest(range(1, 7)) AS node FROM l),
s AS (SELECT parents, parents[x.node] AS up, sample, sum(f.f) AS below FROM x JOIN f ON f.node = x.node GROUP BY ALL),
bad AS (SELECT DISTINCT parents FROM s JOIN f ON s.up = f.node AND s.sample = f.sample WHERE s.below > f.f + 1e-9),
fit AS (SELECT parents FROM l WHERE parents NOT IN (SELECT parents FROM bad))"""
)


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges of a tree of six groups of nodes, and frequencies that come from it."""
    group = (1 + (F.col("node") - 1) % 6).alias("node")
    c = cells(spark, d).select(group, "sample", "n").groupBy("node", "sample").agg(F.sum("n").alias("n"))
    edges = c.select("node").distinct().select("node", F.floor(F.col("node") / 2).cast("int").alias("parent"))
    return edges, T.f_from_eta(edges, shares(c))


@query(ENUMERATED_SQL + " SELECT parents FROM fit")
def enumerate_trees(spark: SparkSession, d: str) -> DataFrame:
    """All trees that the frequencies of six groups of nodes allow; the frequencies come from a tree, so there is one at least."""
    return enumerate_all(_groups(spark, d)[1])


@query(ENUMERATED_SQL + " SELECT count(*) AS n_trees FROM fit")
def count_trees(spark: SparkSession, d: str) -> DataFrame:
    """Their number, the last level only counted."""
    return count_all(_groups(spark, d)[1])


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """A simulation's truth as ``formats.TRUTH`` has it: the six groups, with the nodes that they pool as mutations."""
    edges, freq = _groups(spark, d)
    members = nodes(spark, d).groupBy((1 + (F.col("node") - 1) % 6).alias("group")).agg(F.array_sort(F.collect_list("node")).alias("own"))
    clusters = members.agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "own"))), lambda x: F.transform(x["own"], lambda i: F.concat(F.lit("s"), i))).alias("clusters"))
    one = F.lit(1).alias("_one")
    rows = matrix_column(freq, "f", []).select(F.col("matrix").alias("phi"), one).join(T.parents_of(edges).select(F.col("parents").alias("structure"), one), "_one")
    return rows.join(clusters.select("clusters", one), "_one").drop("_one").withColumn("vids_garbage", F.array().cast("array<string>"))


TRUTH_SQL = """, m AS (SELECT DISTINCT 1 + (CAST(substr(p_brand, 7) AS INT) - 1) % 6 AS grp, CAST(substr(p_brand, 7) AS INT) AS node FROM part),
cl AS (SELECT list(own ORDER BY grp) AS clusters FROM (SELECT grp, list('s' || node ORDER BY node) AS own FROM m GROUP BY grp)),
ph AS (SELECT list(r ORDER BY node) AS phi FROM (SELECT node, list(round(f, 6) + 0.0 ORDER BY sample) AS r FROM f GROUP BY node))"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("phi", F.transform("phi", lambda row: F.transform(row, lambda x: F.round(x, 6) + 0.0)))


@query(GROUPS_SQL + TRUTH_SQL + " SELECT 'truth' AS method, 0 AS tree_idx, (SELECT list(parent ORDER BY node) FROM e) AS parents, phi, 1::BIGINT AS count, 0.0::DOUBLE AS llh, 1.0::DOUBLE AS prob, clusters FROM ph, cl")
def truth_tree(spark: SparkSession, d: str) -> DataFrame:
    """The true tree alone, as a method of its own."""
    return _rounded(truth_trees(_truth(spark, d)))


@query(
    ENUMERATED_SQL
    + TRUTH_SQL
    + """ SELECT 'truth' AS method, CAST(row_number() OVER (ORDER BY parents) - 1 AS INT) AS tree_idx, parents, phi, 1::BIGINT AS count, 0.0::DOUBLE AS llh,
  1.0 / count(*) OVER () AS prob, clusters FROM fit, ph, cl"""
)
def truth_enumerated(spark: SparkSession, d: str) -> DataFrame:
    """All trees that the true frequencies allow, of equal weight."""
    return _rounded(truth_trees(_truth(spark, d), enumerate_all(_groups(spark, d)[1])))
