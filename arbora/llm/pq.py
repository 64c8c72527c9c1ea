"""Near-duplicate vectors: inverted lists with product-quantised residuals, probed near their borders, reranked by exact cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from arbora.llm.graph import components, forest
from arbora.llm.vectors import finite, kmeans, matrix, nearest
from arbora.plans import stash

COSINE = 0.95
#: Rows that one inverted list should hold: the number of lists grows with the vectors.
LIST_ROWS = 512
#: Bounds of the model: rows it is fitted on (about), coarse centers, subspaces, and codes of each.
SAMPLE_ROWS = 40_000
COARSE_LISTS = 1024
SUBSPACES = 8
CODES = 64
#: How far across borders a vector probes, in units of the step that a link makes along one direction (radius / sqrt(dim)).
#: Both ends of a link probe, so it is missed only if it lies beyond that from both.
SLACK = 1.75
#: Rows of one list that meet in one block, as index and as queries; longer lists are split into blocks of about this size.
BLOCK_ROWS = 4096

_ROUNDING = 1e-6


@dataclass(frozen=True)
class PQ:
    """Coarse centers, and for each subspace the code words of the residuals, padded to whole subspaces."""

    centers: np.ndarray
    words: np.ndarray  # subspace, code, component

    def split(self, residual: np.ndarray) -> np.ndarray:
        m, _, width = self.words.shape
        padded = np.zeros((len(residual), m * width))
        padded[:, : residual.shape[1]] = residual
        return padded.reshape(len(residual), m, width)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far the coded residual is from the true one."""
        parts = self.split(residual)
        codes, error = np.empty(parts.shape[:2], np.uint8), np.zeros(len(parts))
        for m in range(parts.shape[1]):
            codes[:, m], d = nearest(parts[:, m], self.words[m])
            error += ((parts[:, m] - self.words[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query residuals from coded residuals: one table for each query, then lookups."""
        parts, total = self.split(residual), np.zeros((len(residual), len(codes)))
        for m in range(parts.shape[1]):
            _, table = nearest(parts[:, m], self.words[m])
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def fit(x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> PQ:
    """Fit on unit vectors."""
    centers = kmeans(x, lists)
    at, _ = nearest(x, centers)
    width = -(-x.shape[1] // min(subspaces, x.shape[1]))
    m = -(-x.shape[1] // width)
    residual = np.zeros((len(x), m * width))
    residual[:, : x.shape[1]] = x - centers[at]
    words = np.zeros((m, codes, width))
    for i in range(m):
        own = kmeans(residual[:, i * width : (i + 1) * width], codes, seed=i)
        words[i] = own[np.minimum(np.arange(codes), len(own) - 1)]
    return PQ(centers, words)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that very large or small numbers don't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def layout(n: int, list_rows: int, coarse: int, codes: int, subspaces: int) -> tuple[int, int]:
    """(coarse centers, residual codes in a list's key) that give about ``n / list_rows`` lists."""
    wanted, levels = max(1.0, n / list_rows), 0
    while wanted / codes**levels > coarse and levels < subspaces:
        levels += 1
    return max(1, min(coarse, round(wanted / codes**levels))), levels


def _beyond(d: np.ndarray, at: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each row and cell, the squared distance to the border between the cell and the row's own; 0 for its own."""
    each = np.arange(len(at))
    with np.errstate(divide="ignore", invalid="ignore"):
        away = (d - d[each, at][:, None]) / (2 * between[at])
    away = np.where(np.isnan(away), np.inf, away)  # 0 / 0 for a center that repeats: never used
    away[each, at] = 0
    return away * away


class Lists:
    """Where vectors live and which lists they probe. A list is a coarse center and the first ``levels`` residual codes."""

    def __init__(self, model: PQ, levels: int, slack: float):
        self.model, self.levels, self.slack = model, levels, slack
        self.between = np.sqrt(nearest(model.centers, model.centers)[1])
        self.word_between = [np.sqrt(nearest(w, w)[1]) for w in model.words[:levels]]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row, row of each probe in order, list of each probe)

        A probed list may lie beyond a border of the coarse cells and one in each coded subspace. These borders are about at
        right angles, so the distance to the list is the root of their squares' sum: that has to stay within the slack. The
        lists probed then don't multiply from level to level.
        """
        at, d = nearest(x, self.model.centers)
        away = _beyond(d, at, self.between)
        room = self.slack**2 + _ROUNDING
        row, coarse = np.nonzero(away <= room)
        spent, home, probe = away[row, coarse], at.astype(np.int64), coarse.astype(np.int64)
        codes = self.model.words.shape[1]
        for m in range(self.levels):
            part = lambda i, c: self.model.split(x[i] - self.model.centers[c])[:, m]  # noqa: E731, B023
            own, _ = nearest(part(np.arange(len(x)), at), self.model.words[m])
            home = home * codes + own
            code, d = nearest(part(row, coarse), self.model.words[m])
            away = spent[:, None] + _beyond(d, code, self.word_between[m])
            i, word = np.nonzero(away <= room)
            row, coarse, probe, spent = row[i], coarse[i], probe[i] * codes + word, away[i, word]
        return home, row, probe

    def center(self, key: int) -> np.ndarray:
        return self.model.centers[key // self.model.words.shape[1] ** self.levels]


ROWS = "rid long, weight long, vec array<{0}>, home long, probes array<long>"


def _assigner(lists: Lists, dim: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            homes, counts, probes = [], [], []
            for start in range(0, batch.num_rows, 1024):
                x = unit(matrix(batch.column(2).slice(start, 1024), dim))
                home, row, probe = lists.place(x)
                homes.append(home)
                counts.append(np.bincount(row, minlength=len(x)))
                probes.append(probe)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            probed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(probes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(homes)), probed], ["rid", "weight", "vec", "home", "probes"])

    return run


class _Block:
    """The index rows of one block of one list: exact vectors, codes, and the lists that each row probes itself."""

    def __init__(self, key: tuple, lists: Lists):
        self.key, self.model, self.center, self.parts = key, lists.model, lists.center(key[0]), []

    def add(self, rid: np.ndarray, weight: np.ndarray, x: np.ndarray, probes: pa.ListArray) -> None:
        owner = np.repeat(np.arange(len(rid)), np.diff(probes.offsets.to_numpy()))
        self.parts.append((rid, weight, x, *self.model.encode(x - self.center), owner, probes.flatten().to_numpy()))

    def search(self, x: np.ndarray, home: np.ndarray, cosine: float, radius: float) -> Iterator[tuple]:
        """(query, id, weight of each link, whether its other end does not probe the query's home), some queries at a time."""
        for rid, weight, own, codes, error, owner, probed in self.parts:
            for start in range(0, len(x), 256):
                q = x[start : start + 256]
                close = self.model.distances(q - self.center, codes) <= radius + error[None, :] + _ROUNDING
                a, b = np.nonzero(close)
                right = np.einsum("ij,ij->i", q[a], own[b]) >= cosine
                a, b = start + a[right], b[right]
                alone, away = np.zeros(len(a), bool), np.flatnonzero(home[a] != self.key[0])
                if len(away):
                    names, at = np.unique(np.concatenate([probed, home[a[away]]]), return_inverse=True)
                    known = owner * len(names) + at[: len(probed)]
                    alone[away] = ~np.isin(b[away] * len(names) + at[len(probed) :], known)
                yield a, rid[b], weight[b], alone


def _searcher(lists: Lists, dim: int, cosine: float, radius: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(7)]
            keys = np.stack(cols[:4], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            x = unit(matrix(batch.column(8), dim))
            out: list[list[np.ndarray]] = [[], [], []]
            for rows in np.split(np.arange(len(keys)), cuts):
                key, is_query = tuple(keys[rows[0], :3].tolist()), keys[rows[0], 3]
                if block is None or block.key != key:
                    block = _Block(key, lists)
                rid, weight, home = (c[rows] for c in cols[4:7])
                if not is_query:
                    block.add(rid, weight, x[rows], batch.column(7).slice(rows[0], len(rows)))
                    continue
                found = np.zeros(len(rows), np.int64)
                for a, other, more, alone in block.search(x[rows], home, cosine, radius):
                    np.add.at(found, a, more)
                    back, at = np.unique(other[alone], return_inverse=True)
                    node, root = forest(rid[a], other) if len(a) else (a, a)
                    for c, v in zip(out, (np.bincount(at, weight[a[alone]], len(back)).astype(np.int64), back, back)):
                        c.append(v)
                    for c, v in zip(out, (np.zeros_like(node), node, root)):
                        c.append(v)
                some = found > 0
                for c, v in zip(out, (found[some], rid[some], rid[some])):
                    c.append(v)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n", "a", "b"])

    return run


def cosine_links(vectors: DataFrame, dim: int, cosine: float = COSINE, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors of ``dim`` components (rid, weight, vec): link counts (rid, n) and links with the same components (a, b).

    Unit vectors live in the list of their nearest center and residual codes, and probe every list within
    ``slack * radius / sqrt(dim)`` (see ``Lists.place``), for the radius of the threshold. A link whose ends live in two lists is
    found if either end probes the other's list, and is then counted for both; for a link of random direction that reaches over
    three standard deviations across a border (``slack >= sqrt(2 * dim)`` is lossless). The probes of a vector grow with the
    number of lists, but slowly: 6 for 50,000 isotropic vectors of 64 dimensions, 18 for 10**6, 76 for 10**8. In a
    list, the asymmetric distance may be wrong by the coding error of the row, which the index knows, so rows beyond the
    threshold plus that error are dropped without loss; the exact cosine decides on the rest.

    ``n`` counts ``weight`` rows for each linked vector, the vector's own included. A block's links are thinned to a forest
    before they leave the task, so groups of near copies give rows in proportion to their size. Lists of any length are split
    into blocks, on the index and on the query side. The model is fitted on about ``SAMPLE_ROWS`` vectors at most.
    """
    n = vectors.count()
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    coarse, levels = layout(n, LIST_ROWS, COARSE_LISTS, CODES, SUBSPACES)
    wanted = min(SAMPLE_ROWS, max(64 * coarse, 64 * CODES))
    chosen = F.shiftrightunsigned(F.xxhash64("vec"), 1) / F.lit(float(1 << 63)) < min(1.0, wanted / max(n, 1))
    sample = vectors.where(chosen).select("vec").toArrow().column(0).combine_chunks()  # about ``wanted`` rows
    if not len(sample):
        sample = vectors.limit(1).select("vec").toArrow().column(0).combine_chunks()
    lists = Lists(fit(unit(matrix(sample, dim)), coarse), levels, radius * min(2**0.5, slack / dim**0.5))
    kind = vectors.schema["vec"].dataType.elementType.simpleString()
    rows = stash(vectors.select("rid", "weight", "vec").mapInArrow(_assigner(lists, dim), ROWS.format(kind)), "lists")

    long = F.lit(BLOCK_ROWS)
    own = rows.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count(F.lit(1)) / long).cast("int").alias("blocks"))
    asked = rows.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / long).cast("int").alias("shares"))
    sizes = stash(own.join(asked, "list"), "list_sizes")
    part = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = rows.withColumn("list", F.col("home")).join(sizes, "list").withColumn("block", part("blocks"))
    index = index.select("list", "block", every("shares").alias("share"), F.lit(0).alias("query"), "rid", "weight", "home", "probes", "vec")
    query = rows.select("rid", "weight", "home", "vec", F.explode("probes").alias("list")).join(sizes, "list").withColumn("share", part("shares"))
    query = query.select("list", every("blocks").alias("block"), "share", F.lit(1).alias("query"), "rid", "weight", "home", F.array().cast("array<long>").alias("probes"), "vec")
    keys = ["list", "block", "share"]
    both = index.unionByName(query).repartition(*keys).sortWithinPartitions(*keys, "query")
    found = stash(both.mapInArrow(_searcher(lists, dim, cosine, radius), "n long, a long, b long"), "links")
    return found.where("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n")), found.where("n = 0").select("a", "b")


def vector_groups(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", slack: float = SLACK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``embeddings``.

    Equal vectors are one node with a weight, so a group of copies costs one row in the search and still counts in full.
    Vectors that are null, empty, all zero, or hold a null or a number that isn't finite link with nothing, nor do rows without
    an id; such a row is its own component. Vectors of one length are compared with each other, each length by an index of its
    own. Repeated rows count as further vectors, and rows that share an id are told apart by their vectors. Extra columns,
    labels too, are ignored; an empty table gives an empty result.
    """
    kind = "float" if isinstance(embeddings.schema[vec_col].dataType.elementType, FloatType) else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    fits = F.col("vec_id").isNotNull() & finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    hashes = {"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("vector"), "vec")}  # 128 bits of a vector, to find its node again
    rows = rows.select("vec_id", F.when(F.coalesce(fits, F.lit(False)), F.col("vec")).alias("vec"))
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    distinct = stash(distinct.select(F.monotonically_increasing_id().alias("rid"), "id", "weight", "vec", F.size("vec").alias("dim")).withColumns(hashes), "distinct_vectors")
    lengths = [r["dim"] for r in distinct.select("dim").distinct().collect()]
    found = [cosine_links(distinct.where(F.col("dim") == n), n, cosine, slack) for n in sorted(lengths)]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, links = (reduce(DataFrame.unionByName, x) for x in zip(*found))
    nodes = distinct.select("rid", "id", "h1", "h2").join(counts, "rid", "left").join(components(links).withColumnRenamed("node", "rid"), "rid", "left")
    nodes = stash(nodes, "nodes")
    first = nodes.where("component is not null").groupBy("component").agg(F.min("id").alias("first"))
    heads = nodes.join(first, "component", "left").select("h1", "h2", "n", F.coalesce("first", "id").alias("component"))
    out = rows.select("vec_id", *[F.when(F.col("vec").isNotNull(), h).alias(c) for c, h in hashes.items()]).join(heads, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Vectors of cosine 0.95 and more: vec_id, n_links, component_id, kept."""
    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
