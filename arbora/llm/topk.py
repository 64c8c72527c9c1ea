"""Exact top-k by inner product: cover trees of queries against cover trees of candidates, first whole cells, then their nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from arbora.llm.vectors import finite, kmeans, matrix, nearest
from arbora.plans import stash

K = 5
#: Queries that share one tree, candidates that share one tree, and candidates that one tree of queries meets in one task.
QUERY_ROWS = 8192
BLOCK_ROWS = 4096
SHARD_ROWS = 8192
LEAF_ROWS = 48
QUERY_LEAF_ROWS = 24
#: The top level of the trees: at most so many cells around pivots, which are fitted on about so many rows.
CELLS = 256
SAMPLE_ROWS = 20_000

_NONE = -(1 << 62)


class Node:
    """Rows ``low``..``high`` of a tree's order, all within ``radius`` of ``center``."""

    __slots__ = ("low", "high", "center", "norm", "radius", "children")

    def __init__(self, low: int, high: int, center: np.ndarray, radius: float):
        self.low, self.high, self.center, self.radius = low, high, center, radius
        self.norm, self.children = float(np.sqrt(center @ center)), []


def cover_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Node, np.ndarray]:
    """A cover tree of the rows of ``x`` and the order of rows that its nodes refer to.

    A node's center is one of its rows. Its children halve the radius: the first keeps the center, each further one is the row
    farthest from all centers so far, until all rows are covered; so centers of one level are farther apart than its radius.
    Rows whose child would hold few rows share leaves around the node's own center, with the radius that those need.
    """
    order, n = np.empty(len(x), np.int64), 0

    def leaf(rows: np.ndarray, center: np.ndarray, far: np.ndarray) -> Node:
        nonlocal n
        order[n : n + len(rows)] = rows
        n += len(rows)
        return Node(n - len(rows), n, center, float(far.max()))

    def build(rows: np.ndarray, center: np.ndarray, far: np.ndarray) -> Node:
        radius = float(far.max())
        if len(rows) <= leaf_rows or radius == 0:
            return leaf(rows, center, far)
        start, best, at = n, far.copy(), np.zeros(len(rows), np.int64)
        centers = [center]
        while best.max() > radius / 2 and len(centers) < len(rows) // 4:
            centers.append(x[rows[int(best.argmax())]])
            d = np.sqrt(((x[rows] - centers[-1]) ** 2).sum(1))
            closer = d < best
            best[closer], at[closer] = d[closer], len(centers) - 1
        size = np.bincount(at, minlength=len(centers))
        few = (size[at] < leaf_rows // 4) | (best > radius / 2)
        children = []
        for c in np.unique(at[~few]):
            own = (at == c) & ~few
            if own.all():  # no progress: cut by distance instead
                few[:] = True
                break
            children.append(build(rows[own], centers[c], best[own]))
        rest = np.flatnonzero(few)
        rest = rest[np.argsort(far[rest], kind="stable")]
        children += [leaf(rows[p], center, far[p]) for p in np.split(rest, range(leaf_rows, len(rest), leaf_rows)) if len(p)]
        node = Node(start, n, center, radius)
        node.children = children
        return node

    first = x.mean(axis=0)
    near = int(((x - first) ** 2).sum(1).argmin())
    root = build(np.arange(len(x)), x[near], np.sqrt(((x - x[near]) ** 2).sum(1)))
    return root, order


def ball_bound(product: np.ndarray, q_norm, r_norm, q_radius, r_radius) -> np.ndarray:
    """No inner product of a row within ``q_radius`` of one center and one within ``r_radius`` of the other is larger; a little is
    added for rounding."""
    top = product + q_radius * r_norm + r_radius * q_norm + q_radius * r_radius
    return top + 1 + 1e-9 * (q_norm + q_radius) * (r_norm + r_radius)


def cone_bound(cosine: np.ndarray, q_angle, r_angle, q_longest, r_longest) -> np.ndarray:
    """The same for rows within two angles of their centers and of lengths up to two norms."""
    least = np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - q_angle - r_angle)
    return np.maximum(0.0, np.cos(least)) * q_longest * r_longest * (1 + 1e-9) + 1


class Search:
    """The queries of one tree, what each must reach, and their best candidates so far."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, floor: np.ndarray, x: np.ndarray, k: int):
        self.root, order = cover_tree(x, QUERY_LEAF_ROWS)
        self.rids, self.ids, self.floor, self.x, self.k, self.met = rids[order], ids[order], floor[order], x[order], k, 0
        self.scores = np.full((len(ids), k), _NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.largest = float(np.abs(x).max(initial=0))

    def scan(self, rids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Meet a block of candidates. Pairs of nodes are pruned if no inner product can reach the group's worst kth score."""
        root, order = cover_tree(x)
        rids, ids, x = rids[order], ids[order], x[order]
        exact = self.largest * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53
        own, other = (self.x, x) if exact else (self.x.astype(np.int64), x.astype(np.int64))
        stack = [(self.root, root)]
        while stack:
            q, r = stack.pop()
            if self._bound(q, r) < self._wanted(q).min():
                continue
            if not q.children and not r.children:
                self._meet(q, own[q.low : q.high] @ other[r.low : r.high].T, rids[r.low : r.high], ids[r.low : r.high])
            elif r.children and (not q.children or r.radius >= q.radius):
                stack += [(q, c) for c in sorted(r.children, key=lambda c: self._bound(q, c))]
            else:
                stack += [(c, r) for c in q.children]

    def _wanted(self, q: Node) -> np.ndarray:
        return np.maximum(self.scores[q.low : q.high, -1], self.floor[q.low : q.high])

    @staticmethod
    def _bound(q: Node, r: Node) -> float:
        return float(ball_bound(float(q.center @ r.center), q.norm, r.norm, q.radius, r.radius))

    def _meet(self, q: Node, scores: np.ndarray, rids: np.ndarray, ids: np.ndarray) -> None:
        self.met += scores.size
        scores = scores.astype(np.int64)
        scores[self.rids[q.low : q.high, None] == rids[None, :]] = _NONE
        wanted = np.maximum(self._wanted(q), _NONE + 1)
        for i in np.flatnonzero((scores >= wanted[:, None]).any(axis=1)):
            row, some = q.low + i, scores[i] >= wanted[i]
            s, d = np.append(self.scores[row], scores[i][some]), np.append(self.found[row], ids[some])
            best = np.lexsort((d, -s))[: self.k]
            self.scores[row], self.found[row] = s[best], d[best]

    def results(self) -> pa.RecordBatch:
        row, rank = np.nonzero(self.scores != _NONE)
        cols = (self.rids[row], self.ids[row], self.found[row, rank], self.scores[row, rank])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rid", "query_id", "vec_id", "score"])


FOUND = "rid long, query_id long, vec_id long, score long"
PAIRED = ["tree", "part", "shard", "candidate", "rid", "vec_id", "floor", "vec"]


def _searcher(dim: int, k: int) -> Callable:
    """Rows come sorted by ``PAIRED``'s first columns: for each tree, part and shard its queries first, then its candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search, kept = None, None, {0: [], 1: []}

        def queries() -> None:
            nonlocal search
            if search is None and kept[0]:
                search = Search(*(np.concatenate(c) for c in zip(*kept[0])), k)

        def candidates(all_of_them: bool) -> None:
            queries()
            while kept[1] and (all_of_them or sum(len(a) for a, *_ in kept[1]) >= BLOCK_ROWS):
                rids, ids, _, x = (np.concatenate(c) for c in zip(*kept[1]))
                if search is not None:
                    search.scan(rids[:BLOCK_ROWS], ids[:BLOCK_ROWS], x[:BLOCK_ROWS])
                kept[1] = [(rids[BLOCK_ROWS:], ids[BLOCK_ROWS:], ids[BLOCK_ROWS:], x[BLOCK_ROWS:])] if len(ids) > BLOCK_ROWS else []

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(7)]
            keys, x = np.stack(cols[:4], axis=1), matrix(batch.column(7), dim)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for rows in np.split(np.arange(len(keys)), cuts):
                if key != (now := tuple(keys[rows[0], :3].tolist())):
                    if key is not None:
                        candidates(True)
                        if search is not None:
                            yield search.results()
                    key, search, kept = now, None, {0: [], 1: []}
                kept[int(keys[rows[0], 3])].append((*(c[rows] for c in cols[4:7]), x[rows]))
                if kept[1]:
                    candidates(False)
        if key is not None:
            candidates(True)
            if search is not None:
                yield search.results()

    return run


def _place(centers: np.ndarray, dim: int) -> Callable:
    """struct<cell, far, angle, length>: the nearest pivot, the distance and angle to it, and the vector's norm."""
    norms = np.sqrt((centers * centers).sum(1))

    @F.arrow_udf("cell int, far double, angle double, length double")
    def place(vecs: pa.Array) -> pa.Array:
        x = matrix(vecs, dim)
        cell, d = nearest(x, centers)
        length = np.sqrt((x * x).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (x * centers[cell]).sum(1) / (length * norms[cell])
        angle = np.where(np.isfinite(cosine), np.arccos(np.clip(cosine, -1, 1)), np.pi)
        far = np.sqrt(((x - centers[cell]) ** 2).sum(1))
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(far), pa.array(angle), pa.array(length)], ["cell", "far", "angle", "length"])

    return place


def surviving_cells(queries: list[Row], candidates: list[Row], centers: np.ndarray) -> np.ndarray:
    """Which pairs of a cell of queries and one of candidates (rows of cell, far, angle, length; queries with floor) can hold a
    result: no pair that a ball or a cone bounds below the queries' worst floor."""
    a, b = (np.array([r["cell"] for r in rows], int) for rows in (queries, candidates))
    column = lambda rows, c: np.array([r[c] for r in rows], float)
    norms, product = np.sqrt((centers * centers).sum(1)), centers[a] @ centers[b].T
    across = np.outer(norms[a], norms[b])
    cosine = np.divide(product, across, out=np.ones_like(product), where=across > 0)
    ball = ball_bound(product, norms[a][:, None], norms[b][None], column(queries, "far")[:, None], column(candidates, "far")[None])
    cone = cone_bound(cosine, column(queries, "angle")[:, None], column(candidates, "angle")[None], column(queries, "length")[:, None], column(candidates, "length")[None])
    return np.minimum(ball, cone) >= column(queries, "floor")[:, None]


def _deal(queries: list[Row], candidates: list[Row], centers: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """(cell, tree, parts, shards) for cells of queries and (cell, tree, parts, shard, slices) for cells of candidates that a tree
    must meet. A tree gathers neighbouring cells up to ``QUERY_ROWS`` queries; a larger cell is a tree of several parts. A shard
    gathers cells of candidates up to ``SHARD_ROWS``; a larger cell is dealt to several shards."""
    alive = surviving_cells(queries, candidates, centers)
    direction = np.linalg.svd(centers - centers.mean(0), full_matrices=False)[2][0]
    order = lambda rows: sorted(range(len(rows)), key=lambda i: float(centers[rows[i]["cell"]] @ direction))
    trees: list[list[int]] = []
    room = 0
    for i in order(queries):
        if queries[i]["n"] > room:
            trees.append([])
            room = QUERY_ROWS
        trees[-1].append(i)
        room -= queries[i]["n"]
    asked, met = [], []
    for t, cells in enumerate(trees):
        parts = -(-sum(queries[i]["n"] for i in cells) // QUERY_ROWS)
        shard, room = -1, 0
        for j in order(candidates):
            if not alive[cells, j].any():
                continue
            slices = max(1, -(-candidates[j]["n"] // SHARD_ROWS))
            if candidates[j]["n"] > room:
                shard, room = shard + 1, SHARD_ROWS
            met.append((candidates[j]["cell"], t, parts, shard, slices))
            shard, room = shard + slices - 1, 0 if slices > 1 else room - candidates[j]["n"]
        asked += [(queries[i]["cell"], t, parts, shard + 1) for i in cells]
    return asked, met


def _search(queries: DataFrame, candidates: DataFrame, dim: int, k: int) -> DataFrame:
    both = queries.withColumn("candidate", F.lit(0)).select(*PAIRED, "cell").unionByName(candidates.withColumns({"candidate": F.lit(1), "floor": F.lit(0).cast("long")}).select(*PAIRED, "cell"))
    keys = ["tree", "part", "shard"]
    both = both.repartition(*keys).sortWithinPartitions(*keys, "candidate", "cell", "rid")
    return both.select(*PAIRED).mapInArrow(_searcher(dim, k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _top_k(rows: DataFrame, dim: int, k: int) -> DataFrame:
    spark, n = rows.sparkSession, rows.count()
    chosen = F.shiftrightunsigned(F.xxhash64("vec", "vec_id"), 1) / F.lit(float(1 << 63)) < min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = rows.where(chosen).select("vec").toArrow().column(0).combine_chunks()  # about SAMPLE_ROWS rows
    if not len(sample):
        sample = rows.limit(1).select("vec").toArrow().column(0).combine_chunks()
    centers = kmeans(matrix(sample, dim), min(CELLS, max(1, n // BLOCK_ROWS)))
    placed = rows.withColumn("at", _place(centers, dim)("vec")).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vec", "asked", "at.*")
    placed = stash(placed, "placed")
    parted = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # First the queries of a cell meet one block of their own cell, for a score that k candidates reach.
    shape = [F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("angle").alias("angle"), F.max("length").alias("length")]
    held = {r["cell"]: r for r in placed.groupBy("cell").agg(*shape).collect()}  # CELLS rows at most
    sizes = placed.where("asked").groupBy("cell").count().collect()  # CELLS rows at most
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = [(r["cell"], -(-r["count"] // QUERY_ROWS), -(-held[r["cell"]]["n"] // BLOCK_ROWS)) for r in sizes]
    own = placed.join(F.broadcast(spark.createDataFrame(wanted, "cell int, parts int, blocks int")), "cell").withColumns({"tree": F.col("cell"), "shard": F.lit(0)})
    near = own.where(parted(F.col("blocks")) == 0).withColumn("part", every(F.col("parts")))
    some = own.where("asked").withColumns({"part": parted(F.col("parts")), "floor": F.lit(_NONE).cast("long")})
    reached = _search(some, near, dim, k).groupBy("rid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = stash(placed.where("asked").join(reached, "rid", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE).cast("long"))), "queries")

    # Then each tree of queries meets the cells that can still hold a result.
    groups = asked.groupBy("cell").agg(*shape, F.min("floor").alias("floor")).collect()  # CELLS rows at most
    trees, cells = _deal(groups, list(held.values()), centers)
    trees = F.broadcast(spark.createDataFrame(trees, "cell int, tree int, parts int, shards int"))  # CELLS rows at most
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, tree int, parts int, shard int, slices int"))  # CELLS squared
    queries = asked.join(trees, "cell").withColumns({"part": parted(F.col("parts")), "shard": every(F.col("shards"))})
    others = placed.join(cells, "cell").withColumns({"part": every(F.col("parts")), "shard": F.col("shard") + parted(F.col("slices"))})
    return _best(_search(queries, others, dim, k), k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product for each query, ties to the smaller id.

    ``vectors`` has vec_id and vec, an array of whole numbers. All rows are candidates but the query's own row; rows that repeat
    an id are queries and candidates of their own. The trees' top level are cells around pivots. A cell's queries first meet a
    block of their own cell; the worst score that k candidates reach there is what a cell of candidates must be able to reach,
    by balls or by cones, to be sent to a tree of queries at all. A task streams the cells sent to it in blocks, so its memory
    is bounded, and goes on pruning by nodes of both trees. Only k rows for each query and shard are shuffled for the last rank.

    Rows without an id, and vectors that are null, empty, or hold a null or a number that isn't finite take no part. Vectors of
    different lengths have no inner product: each length is searched by itself. Fewer than k candidates give fewer rows; an
    empty table or no query gives none. Scores beyond 64 bits are not supported.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite("vec")).select(F.col("vec_id").cast("long").alias("vec_id"), "vec", F.coalesce(is_query, F.lit(False)).alias("asked"))
    lengths = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, [_top_k(rows.where(F.size("vec") == n), n, k) for n in lengths])


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by integer inner product for every row whose id is divisible by 50: query_id, rank, vec_id, score."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = rows.where(finite("embedding")).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"))
    return top_k(whole, F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
