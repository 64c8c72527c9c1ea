"""Reconstruction quality: log-perplexity of frequencies and loss of pairwise relationships."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import clip, log_binom_pmf, softmax
from arbora.functions.numeric import LLH_CLIP
from arbora.operators.rank import global_rank, neighbours
from arbora.plans import stash
from arbora.sources.formats import require

#: Relationships of clones i and j (fixed values): i is j's ancestor, its descendant, the same clone, on another branch.
ANCESTRAL, DESCENDANT, COCLUSTER, BRANCHED = 0, 1, 2, 3
MISSING = -1.0


def tree_weights(trees: DataFrame, with_counts: bool) -> DataFrame:
    """method, tree, w: softmax of llh, or of llh + ln count."""
    x = F.col("llh") + F.ln("count") if with_counts else F.col("llh")
    return trees.withColumn("x", x).select("method", "tree", softmax(F.col("x"), Window.partitionBy("method")).alias("w"))


def perplexity(trees: DataFrame, freq: DataFrame, members: DataFrame, mut_cells: DataFrame, top_tree: bool = False, same_shape: bool = False) -> DataFrame:
    """method, score: minus the mean, in bits, of the mutations' log masses, weighted over trees (log masses, not masses).

    trees: method, tree, llh; freq: method, tree, node, sample, f; members: mut, node; mut_cells: mut, sample, v, n, omega.
    ``top_tree`` takes the likeliest tree alone. Trees of negligible weight are left out. With ``same_shape`` methods that score
    different numbers of mutations and samples are an error.
    """
    w = tree_weights(trees, False).where("w > 1e-8")
    if top_tree:
        likely = trees.join(w, ["method", "tree"])
        first = Window.partitionBy("method").orderBy(F.desc("llh"), "tree")
        w = likely.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("method", "tree", F.lit(1.0).alias("w"))
    rows = freq.join(w, ["method", "tree"]).join(members, "node").join(mut_cells.select("mut", "sample", "v", "n", "omega"), ["mut", "sample"])
    p = clip(F.col("omega") * F.col("f"), LLH_CLIP, 1 - LLH_CLIP)
    rows = rows.withColumn("lp", F.col("w") * log_binom_pmf(F.col("v"), F.col("n"), p))
    size = rows.groupBy("method").agg(F.sum("lp").alias("total"), F.count_distinct("mut", "sample").alias("size"))
    if same_shape:
        require_same_shape(size)
    return size.select("method", (-F.col("total") / F.col("size") / math.log(2)).alias("score"))


def relations(edges: DataFrame, keys: list[str], ancestry: DataFrame | None = None) -> DataFrame:
    """keys, i, j, rel, p = 1 for all pairs of a tree's nodes.

    By default only direct parents are ancestral, and a clone is all of ancestor, descendant and same to itself. With
    ``ancestry`` (keys, anc, node, depth) all ancestors are ancestral, and a clone is only the same to itself.
    """
    nodes = edges.select(*keys, "node").distinct()
    grid = nodes.select(*keys, F.col("node").alias("i")).join(nodes.select(*keys, F.col("node").alias("j")), keys)
    if ancestry is None:
        over = edges.select(*keys, F.col("parent").alias("i"), F.col("node").alias("j")).where("i > 0").unionByName(nodes.select(*keys, F.col("node").alias("i"), F.col("node").alias("j")))
    else:
        over = ancestry.where("anc > 0 and depth > 0").select(*keys, F.col("anc").alias("i"), F.col("node").alias("j"))
    up = over.withColumn("rel", F.lit(ANCESTRAL))
    down = over.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.lit(DESCENDANT).alias("rel"))
    same = nodes.select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(COCLUSTER).alias("rel"))
    some = up.unionByName(down).unionByName(same)
    rest = grid.join(some.select(*keys, "i", "j").distinct(), [*keys, "i", "j"], "left_anti").withColumn("rel", F.lit(BRANCHED))
    return some.unionByName(rest).withColumn("p", F.lit(1.0))


def clone_relation_probs(trees: DataFrame, edges: DataFrame, ancestry: DataFrame | None = None) -> DataFrame:
    """method, i, j, rel, p for clones: relations of all trees (method, tree, llh, count), weighted."""
    w = tree_weights(trees, True)
    return relations(edges, ["method", "tree"], ancestry).join(w, ["method", "tree"]).groupBy("method", "i", "j", "rel").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def relation_probs(trees: DataFrame, edges: DataFrame, members: DataFrame, ancestry: DataFrame | None = None) -> DataFrame:
    """method, a, b, rel, p for mutations: the relations of their clones, one row for each pair of mutations and relation."""
    clones = clone_relation_probs(trees, edges, ancestry)
    a, b = (members.select(F.col("mut").alias(m), F.col("node").alias(n)) for m, n in (("a", "i"), ("b", "j")))
    return clones.join(a, "i").join(b, "j").select("method", "a", "b", "rel", "p")


def _divergence(p: Column, q: Column) -> Column:
    """Aggregate: the Jensen-Shannon divergence, in bits, of two distributions over relations, 1 at most."""
    mid = 0.5 * (p + q)
    kl = lambda x: F.when(x > 0, x * (F.log2(x) - F.log2(mid))).otherwise(0.0)
    return F.least(F.lit(1.0), F.sum(0.5 * (kl(p) + kl(q))))


def relation_loss(probs: DataFrame, truth: DataFrame, strict_lower: bool = False) -> DataFrame:
    """method, score: mean Jensen-Shannon divergence of the relations of mutation pairs, at most 1 for each.

    By default the pairs with b at most one place after a count, in mutation order, so neighbours count twice and the diagonal
    once; ``strict_lower`` takes each pair once. Both are divided by n (n - 1) / 2. ``truth`` (a, b, rel, q) itself scores 0.
    """
    order = stash(global_rank(truth.select(F.col("a").alias("mut")).distinct(), [F.asc("mut")], "place"), "mutation_order", release=False)
    one = F.lit(1).alias("_one")
    methods = probs.select("method", one).distinct()
    full = probs.join(truth, ["a", "b", "rel"], "left").select("method", "a", "b", "rel", "p", F.coalesce("q", F.lit(0.0)).alias("q"))
    only = truth.select("*", one).join(F.broadcast(methods), "_one").join(probs.select("method", "a", "b", "rel"), ["method", "a", "b", "rel"], "left_anti")
    full = full.unionByName(only.select("method", "a", "b", "rel", F.lit(0.0).alias("p"), "q"))
    pair = full.groupBy("method", "a", "b").agg(_divergence(F.col("p"), F.col("q")).alias("jsd"))
    at = lambda c: order.select(F.col("mut").alias(c), F.col("place").alias(f"p{c}"))
    near = F.col("pb") < F.col("pa") if strict_lower else F.col("pb") <= F.col("pa") + 1
    rows = pair.join(at("a"), "a").join(at("b"), "b").where(near)
    n = F.count_distinct("a")
    total = rows.groupBy("method").agg(F.sum("jsd").alias("s"))
    size = truth.agg(n.alias("n")).select("n", one)
    return total.withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one").select("method", (F.col("s") / (0.5 * F.col("n") * (F.col("n") - 1))).alias("score"))


def clone_relation_loss(probs: DataFrame, truth: DataFrame, members: DataFrame, truth_members: DataFrame, strict_lower: bool = False) -> DataFrame:
    """method, score as ``relation_loss`` gives it, without a row for each pair of mutations.

    probs: method, i, j, rel, p and truth: i, j, rel, q for clones; members and truth_members: mut, node. A pair's divergence
    depends only on the classes of its mutations (their clones here and in the truth) and is the same both ways round. So the
    pairs are counted by classes, and all ordered pairs, halved, give each pair once; the diagonal and the pairs of neighbours
    that ``relation_loss`` takes besides are added from the n mutations and n - 1 neighbours.
    """
    mutations = members.select("mut", F.col("node").alias("i")).join(truth_members.select("mut", F.col("node").alias("x")), "mut")
    size = mutations.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    one, two = (size.select(F.col("i").alias(c), F.col("x").alias(t), F.col("n").alias(n)) for c, t, n in (("i", "x", "n"), ("j", "y", "m")))
    grid = probs.select("method", "i", "j").distinct().join(one, "i").join(two, "j").withColumn("rel", F.explode(F.array(*map(F.lit, (ANCESTRAL, DESCENDANT, COCLUSTER, BRANCHED)))))
    rows = grid.join(probs, ["method", "i", "j", "rel"], "left").join(truth.select(F.col("i").alias("x"), F.col("j").alias("y"), "rel", "q"), ["x", "y", "rel"], "left")
    classes = ["i", "x", "j", "y"]
    loss = rows.groupBy("method", *classes).agg(F.first("n").alias("n"), F.first("m").alias("m"), _divergence(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))).alias("jsd"))
    own = (F.col("i") == F.col("j")) & (F.col("x") == F.col("y"))
    pairs = F.col("n") * F.col("m") - F.when(own, F.col("n")).otherwise(0)
    weight = pairs / 2 + (F.lit(0) if strict_lower else F.when(own, F.col("n")).otherwise(0))
    total = loss.select("method", (F.col("jsd") * weight).alias("part"))
    if not strict_lower:
        near = neighbours(mutations, [F.asc("mut")], ["i", "x"]).where("next is not null").select("i", "x", F.col("next.i").alias("j"), F.col("next.x").alias("y")).groupBy(*classes).agg(F.count(F.lit(1)).alias("times"))
        total = total.unionByName(loss.join(near, classes).select("method", (F.col("jsd") * F.col("times")).alias("part")))
    count = mutations.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    total = total.groupBy("method").agg(F.sum("part").alias("s"), F.lit(1).alias("_one"))
    return total.join(count, "_one").select("method", (F.col("s") / (0.5 * F.col("n") * (F.col("n") - 1))).alias("score"))


def plot_score(llh: Column, nodes: Column, samples: Column) -> Column:
    """The score that plots show: minus the log likelihood in bits for each node (the root not counted) and sample."""
    return -llh / (nodes * samples * math.log(2))


def require_same_shape(sizes: DataFrame) -> None:
    """Fail unless all methods (method, size: the number of mutations and samples that they score) have one size."""
    require(sizes.agg(F.min("size").alias("low"), F.max("size").alias("high")).where("low < high"), "methods of different shapes")


def method_scores(methods: DataFrame, scored: DataFrame, truth: str | None = "truth") -> DataFrame:
    """method, score for each named method, in the order of names: -1 where there is no result, 0 for the truth itself.

    A name given twice, in ``methods`` or in ``scored``, is an error.
    """
    for rows in (methods, scored):
        require(rows.groupBy("method").count().where("count > 1"), "methods named several times")
    rows = methods.select("method").join(scored, "method", "left")
    score = F.coalesce("score", F.lit(MISSING))
    if truth is not None:
        score = F.when(F.col("method") == truth, 0.0).otherwise(score)
    return rows.select("method", score.alias("score")).orderBy("method")
