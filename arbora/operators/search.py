"""Beam search over rooted trees, as a loop of DataFrame steps: each step expands the best partial trees of all instances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from arbora.functions import gumbel, gumbel_with_maximum, key_uniform, safe_divide, softmax
from arbora.operators import placement
from arbora.operators.fit import fit_columns, fit_trees, pack, with_data
from arbora.operators.trees import apply_action, parsimony
from arbora.plans import drop, load, save, stash


@dataclass(frozen=True)
class SearchParams:
    """k beam width, f branching factor, e expansion factor (1: best first, k: all of the beam at once).

    model: ``sbs`` cuts with Gumbel noise conditioned on the parent's, ``bs`` by likelihood. node_order: ``fsum``, ``random``,
    or ``diverse`` (the first instance by F-sum, the others random).
    """

    beam_width: int = 1
    branching_factor: int = 20
    expansion_factor: int = 1
    instances: int = 1
    seed: int = 0
    node_order: str = "fsum"
    max_placements: int = 10
    force_monoprimary: bool = False
    ignore_zero_probs: bool = False
    model: str = "sbs"

    def __post_init__(self) -> None:
        if self.model not in ("sbs", "bs") or self.node_order not in ("fsum", "random", "diverse"):
            raise ValueError("model is sbs or bs; node_order is fsum, random or diverse")
        if min(self.beam_width, self.branching_factor, self.expansion_factor, self.instances, self.max_placements) < 1:
            raise ValueError("widths, factors and counts are at least 1")


#: A search is one instance of one run (an input of its own).
KEY = ["run", "instance"]


def _orders(cells: DataFrame, p: SearchParams) -> DataFrame:
    """run, instance, todo: the nodes of each search in the order in which it places them."""
    weight = F.sum(safe_divide(F.col("v"), F.col("n") * F.col("omega")))
    rows = cells.groupBy("run", "node").agg(weight.alias("weight")).withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(p.instances - 1))))
    by_sum = F.lit(p.node_order == "fsum") | (F.lit(p.node_order == "diverse") & (F.col("instance") == 0))
    luck = key_uniform(F.concat_ws("|", F.lit(str(p.seed)), F.col("instance").cast("string"), F.col("node").cast("string")))
    place = F.struct(F.when(by_sum, -F.round("weight", 9)).otherwise(luck).alias("rank"), F.col("node").cast("int").alias("node"))
    return rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["node"]).alias("todo"))


def search(cells: DataFrame, p: SearchParams | None = None, max_steps: int = 10_000, progress: Callable[[dict], None] | None = None) -> DataFrame:
    """instance, parents, score, llh, fits, explored, cut: the complete trees of all instances, at most ``beam_width`` of each.

    ``cells`` (node, sample, v, n, omega) must hold every node 1..n in every sample. With a column ``run`` it holds many inputs,
    each with nodes and samples of its own; all runs and instances take a step together, and the result has ``run`` too.

    Each step takes the ``expansion_factor`` best partial trees of each search off its queue, proposes and scores placements of
    its next node, fits the best ``branching_factor``, cuts them to ``beam_width`` for each parent, and queues those whose
    parents vector is new to the search; the queue is cut to its size, which shrinks by one whenever an expansion completes new
    trees. Queue, seen trees, room and counters stay in tables of shared storage; one row of observed metrics passes through the
    driver each step, however many searches there are. A tree can only have been seen with as many nodes placed, so a step reads
    the hashes (128 bits) of the earlier steps that made trees of its children's sizes, and no other column or step.

    All ranks are total orders and noise is a function of (seed, instance, parents), so results don't depend on partitioning.
    ``explored`` and ``cut`` count the partial trees expanded, and those given up by the cuts, of the search; a queue that has
    shrunk is cut to its shrunken size. ``progress`` is called after each step with the step's number, the sums of explored, cut
    and waiting over all searches, and the best log likelihood of a tree that is alive.
    """
    p = p or SearchParams()
    spark, many = cells.sparkSession, "run" in cells.columns
    cells = cells if many else cells.withColumn("run", F.lit(0))
    cells = stash(cells.select("run", "node", "sample", "v", "n", "omega"), "cells", release=False)
    shape = cells.groupBy("run").agg(F.count_distinct("node").alias("n"), F.count_distinct("sample").alias("m"), F.count(F.lit(1)).alias("rows"), F.max("node").alias("high"))
    if cells.isEmpty() or not shape.where("rows <> n * m or high <> n").isEmpty():
        raise ValueError("cells must hold each of the nodes 1..n once for each sample")
    packed = stash(pack(cells, ["run"]), "packed", release=False)
    n = F.size(F.col("samples")[0]["v"])
    root = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.when(i == 1, 1.0).otherwise(float("nan")))
    fits = F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), root.alias("f"), root.alias("eta")))
    first = packed.join(_orders(cells, p), "run")
    queue = first.select(*KEY, "todo", F.array_repeat(F.lit(-1), n).alias("parents"), F.lit(0).alias("step"), F.lit(0.0).alias("score"), F.lit(0.0).alias("llh"), fits.alias("fits"))
    none = F.lit(0).cast("long")
    rooms = stash(queue.select(*KEY, F.lit(p.beam_width).alias("room"), (none + 1).alias("waiting"), none.alias("explored"), none.alias("cut")), "rooms", release=False)
    columns, states, schema, table = queue.columns, [], None, rooms
    seen = {"low": 0, "high": 0, "widest": 1}
    columns_of = {"candidates": placement.candidate_columns(p.force_monoprimary), "scores": placement.score_columns(), "fits": fit_columns()}
    columns_of["child"] = apply_action("parents", F.col("u"), F.col("v"), F.col("c"))
    hashes = {"h1": F.xxhash64("parents"), "h2": F.xxhash64(F.lit("tree"), "parents")}
    whole, live, same = F.col("step") == F.size("parents"), ~F.col("again"), lambda v: F.size(F.filter("parents", lambda p: (p == v) & (p >= 0)))
    by_rank, by_hash = Window.partitionBy(*KEY).orderBy("score", "parents"), Window.partitionBy(*KEY, *hashes).orderBy(F.desc("old"), "score", "origin")
    not_made = [F.lit(None).cast(kind).alias(c) for c, kind in (("origin", "array<int>"), ("h1", "long"), ("h2", "long"))] + [none.alias("lost"), F.lit(False).alias("new"), F.lit(False).alias("again")]
    per_search = [
        F.size(F.collect_set(F.when(whole & live, F.col("origin")))).alias("finished"), F.count_if(~whole & live).alias("left"), F.sum("lost").alias("lost"), F.max(F.array_max(F.transform("parents", same))).alias("widest"),
        *[f(F.when(of & live, F.col("step"))).alias(name) for name, f, of in (("low", F.min, ~whole), ("high", F.max, ~whole), ("new_low", F.min, F.col("new")), ("new_high", F.max, F.col("new")))], F.max(F.when(live, F.col("llh"))).alias("best"),
    ]
    taken = F.least(F.col("waiting"), F.lit(p.expansion_factor))
    update = [
        *KEY, F.greatest(F.lit(0), F.col("room") - F.coalesce("finished", F.lit(0))).cast("int").alias("room"), F.coalesce("left", none).alias("waiting"), (F.col("explored") + taken).alias("explored"),
        (F.col("cut") + F.greatest(none, F.col("waiting") - F.greatest("room", taken)) + F.coalesce("lost", none)).alias("cut"), "widest", "low", "high", "new_low", "new_high", "best",
    ]
    observed = [F.max("waiting").alias("most"), F.sum("waiting").alias("waiting"), F.sum("explored").alias("explored"), F.sum("cut").alias("cut"), F.max("best").alias("best"), F.max("widest").alias("widest"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("new_low").alias("new_low"), F.max("new_high").alias("new_high")]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    partitions = int(partitions) if partitions.isdigit() else 200
    searches = rooms.count()
    for number in range(1, max_steps + 1):
        ranked = queue.join(rooms.select(*KEY, "room"), KEY).withColumn("rn", F.row_number().over(by_rank))
        branches = ranked.where(F.col("rn") <= p.expansion_factor).select(*columns).repartition(min(partitions, searches * p.expansion_factor), *KEY, "parents")
        fresh = _expand(branches, packed, p, seen["widest"], columns_of).withColumns(hashes | {"new": F.lit(True), "old": F.lit(False)})
        low, high = seen["low"] + 1, seen["high"] + 1
        if paths := [path for path, least, most in states if most is not None and least <= high and most >= low]:
            known = load(spark, schema, *paths).where(F.col("new") & live & F.col("step").between(low, high)).select(*KEY, *hashes, F.lit(True).alias("old"))
            fresh = fresh.unionByName(known, allowMissingColumns=True)
        fresh = fresh.withColumn("again", F.row_number().over(by_hash) > 1).where("not old").select(*columns, "origin", *hashes, "lost", "new", "again")
        kept = ranked.where((F.col("rn") > p.expansion_factor) & (F.col("rn") <= F.col("room"))).select(*columns, *not_made)
        state = fresh.unionByName(kept)
        schema, path = state.schema, save(state, "state")
        state = load(spark, schema, path)
        metrics = Observation()
        after = rooms.join(state.groupBy(*KEY).agg(*per_search), KEY, "left").select(*update).observe(metrics, *observed)
        after = stash(after, "rooms", release=False)
        seen = metrics.get
        states.append((path, seen["new_low"], seen["new_high"]))
        rooms = after.select(*KEY, "room", "waiting", "explored", "cut")
        drop(spark, table)
        table = after
        if progress:
            progress({"step": number, **{c: seen[c] for c in ("explored", "cut", "waiting", "best")}})
        if not seen["most"]:
            break
        queue = state.where(~whole & live).select(*columns)
    done = load(spark, schema, *[path for path, *_ in states]).where(whole & F.col("new") & live).select(*KEY, "parents", "score", "llh", "fits")
    done = done.withColumn("rn", F.row_number().over(by_rank)).where(F.col("rn") <= p.beam_width).drop("rn")
    done = stash(done.join(rooms.select(*KEY, "explored", "cut"), KEY), "complete_trees", release=False)
    drop(spark, *[path for path, *_ in states], table)
    return done if many else done.drop("run")


def _expand(branches: DataFrame, packed: DataFrame, p: SearchParams, widest: int, columns: dict) -> DataFrame:
    """Children of ``branches``, fitted, scored and cut: run, instance, parents, step, score, llh, fits, origin, lost (how many
    children of the same branch were cut, on the first of them).

    Everything of one branch stays in one task, from its candidates to its children. No node of the branches has more than
    ``widest`` children, so no set of children needs more rounds than that.
    """
    rows = branches.select(*KEY, "todo", "parents", "step", F.get("todo", F.col("step")).alias("u"), F.col("score").alias("parent_score"), "fits")
    cands = placement.candidates(with_data(rows, packed, ["run"]), min(p.max_placements, widest), columns=columns["candidates"])
    scored = placement.scores(cands, columns["scores"]).withColumn("score", F.when(F.col("fallback"), 0.0).otherwise(F.col("score")))
    top = placement.best(scored, [*KEY, "parents"], p.branching_factor, p.ignore_zero_probs)
    made = top.select(*KEY, "todo", F.col("parents").alias("origin"), columns["child"].alias("parents"), (F.col("step") + 1).alias("step"), "parent_score")
    made = fit_trees(made, packed, ["run"], columns["fits"])
    over = Window.partitionBy(*KEY, "origin")
    if p.model == "sbs":
        key = F.concat_ws("|", F.lit(str(p.seed)), F.col("instance").cast("string"), F.array_join("origin", ","), F.array_join("parents", ","))
        noisy = made.withColumn("g", F.col("llh") + gumbel(key_uniform(key)))
        noisy = noisy.withColumn("score", -gumbel_with_maximum(F.col("g"), -F.col("parent_score"), F.max("g").over(over))).drop("g")
    else:
        noisy = made.withColumn("score", -F.col("llh"))
    cut = noisy.withColumns({"rn": F.row_number().over(over.orderBy("score", "parents")), "made": F.count(F.lit(1)).over(over)}).where(F.col("rn") <= p.beam_width)
    lost = F.when(F.col("rn") == 1, F.greatest(F.col("made") - p.beam_width, F.lit(0))).otherwise(0).cast("long")
    return cut.select(*KEY, "todo", "parents", "step", "score", "llh", "fits", "origin", lost.alias("lost"))


def package(trees: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rank, parents, llh, prob, count, parsimony, fits: distinct trees of all instances, the likeliest first; for each ``keys``
    (such as run), if given.

    ``prob`` is the softmax of the log likelihoods; ``count`` tells how often a tree was found and does not enter it.
    """
    rows = trees.groupBy(*keys, "parents").agg(F.count(F.lit(1)).alias("count"), F.min_by(F.struct("llh", "fits"), "instance").alias("x"))
    rows = rows.select(*keys, "parents", "count", "x.llh", "x.fits").withColumn("parsimony", parsimony("parents"))
    every = Window.partitionBy(*(keys or [F.lit(1)]))  # a search's results: beam width times instances at most
    return rows.withColumn("prob", softmax(F.col("llh"), every)).withColumn("rank", F.row_number().over(every.orderBy(F.desc("llh"), "parents")))
