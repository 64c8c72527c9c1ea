"""Removal of word passages that repeat anywhere in the corpus: winnowed seeds, extended both ways."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.words import word_lists
from arbora.plans import stash

WINDOW = 35
SEED_WORDS = 8
#: Two 64-bit hashes of id and text name a document. Rows with equal ids and texts share them; their results are the same.
KEY = ["key", "key2"]

#: A key that holds more than one in so many of the rows of a join is looked up in a literal set, of at most so many keys,
#: instead: so no key of a join is hot, whatever the data.
HOT = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hashed:
    """Word hashes of one text, from which the hash of any word range comes in one step."""

    def __init__(self, text: str | None):
        parts = [np.fromiter(map(xxhash.xxh64_intdigest, w), _U, len(w)) for w in word_lists((text or "").encode())]
        words = np.concatenate(parts)
        self.n = len(words)
        up, self.down = _powers(1 << max(12, self.n.bit_length()))
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(words * up[: self.n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of words start..end-1; equal ranges have equal hashes wherever they stand."""
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def spans(self, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, span hash, first window, number of windows): each window once, at the anchor that it selects.

        The anchor of a window is the leftmost of its seeds (runs of ``seed_words`` words) with the smallest hash. The windows
        of one anchor are consecutive; their span is all the words that they cover. Equal windows select equal anchors.
        """
        count, width = self.n - window + 1, window - seed_words + 1
        if count <= 0:
            return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 2
        at = np.arange(self.n - seed_words + 1)
        seeds = low = self.ranges(at, at + seed_words)
        size = 1
        while size < width:
            step = min(size, width - size)
            take = low[step:] < low[:-step]
            low, at = np.where(take, low[step:], low[:-step]), np.where(take, at[step:], at[:-step])
            size += step
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        number = np.diff(np.append(first, count))
        return seeds[at[first]], self.ranges(first, first + number + (window - 1)), first, number


def _columns(batch: pa.RecordBatch, out: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == _U else c.astype(np.int64, copy=False)) for c in cols], names)


def _seeder(window: int, seed_words: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for *key, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                anchor, span, first, number = Hashed(text.as_py()).spans(window, seed_words)
                if len(first):
                    for x, y in zip(out, (*(np.full(len(first), k) for k in key), anchor, span, first * 64 + number)):
                        x.append(y)
            yield _columns(batch, out, [*KEY, "anchor", "span", "at"])

    return run


def _extender(window: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for *key, text, wanted in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)):
                hashed, rows = Hashed(text.as_py()), wanted.values
                at, anchor, often = (rows.field(i).to_numpy() for i in range(3))
                number = at & 63
                each = np.repeat(np.arange(len(at)), number)
                start = (at >> 6)[each] + np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
                for x, y in zip(out, (*(np.full(len(each), k) for k in key), anchor[each], hashed.ranges(start, start + window), start, often[each])):
                    x.append(y)
            yield _columns(batch, out, [*KEY, "anchor", "hash", "start", "often"])

    return run


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.xxhash64(F.lit("document"), F.col(id_col), F.col(text_col)).alias("key2")]


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, key2, at array<long>: for each document (see ``KEY``) with repeats, runs of repeated windows as 64 * start + number.

    Seed: every window selects one anchor by winnowing, so two equal windows meet at equal anchors; about 2 in
    ``window - seed_words + 2`` words start one. Extend: an anchor's span reaches both ways as far as the anchor is selected.
    Equal spans are counted, never paired: a span found twice repeats in all its windows. Where all spans of an anchor are equal
    its count settles them. Where they differ (at the ends of a passage) the spans are counted, and the windows of each distinct
    span, one representative for each, are compared one by one. So the rows grow with the text, not with the square of a group,
    and every count is a partial aggregate. Rows meet the counts of their anchors, spans and windows by joins without hot keys,
    see ``HOT``.
    """
    if not 0 < seed_words <= window < 64 + seed_words - 1:
        raise ValueError("seed_words must lie in 1..window, and an anchor may own 63 windows at most")
    keyed = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    seeds = stash(keyed.mapInArrow(_seeder(window, seed_words), "key long, key2 long, anchor long, span long, at long"), "seeds")

    again = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("span") != F.max("span")).alias("mixed"))
    again = stash(again.where("n > 1"), "repeated_anchors")
    cold, hot = _by_heat(again, "anchor")
    same = _among("anchor", [r["anchor"] for r in hot if not r["mixed"]])
    mixed = _among("anchor", [r["anchor"] for r in hot if r["mixed"]])
    found = seeds.where(~same & ~mixed).join(cold.select("anchor", "mixed"), "anchor").select(*seeds.columns, "mixed")
    if hot:
        found = found.unionByName(seeds.where(same | mixed).withColumn("mixed", mixed))
    found = stash(found, "repeated_seeds")

    mixed = found.where("mixed")
    spans = mixed.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*KEY, "at")])
    spans = stash(spans, "distinct_spans")
    wanted = spans.groupBy(*KEY).agg(F.collect_list(F.struct("at", "anchor", F.least("n", F.lit(2)).alias("often"))).alias("wanted"))
    windows = keyed.join(wanted, KEY).mapInArrow(_extender(window), "key long, key2 long, anchor long, hash long, start long, often long")
    windows = stash(windows, "windows")
    twice = stash(windows.groupBy("anchor", "hash").agg(F.sum("often").alias("n")).where("n > 1"), "repeated_windows")

    whole = found.where("not mixed").select(*KEY, "at")
    for rows, counts, key, at in (
        (mixed, spans.where("n > 1").select("anchor", "span", "n"), "span", F.col("at")),
        (windows.where("often = 1"), twice, "hash", F.col("start") * 64 + 1),
    ):
        cold, hot = _by_heat(counts, key)
        known = _among(key, [r[key] for r in hot])
        whole = whole.unionByName(rows.where(known).select(*KEY, at.alias("at")))
        whole = whole.unionByName(rows.where(~known).join(cold.select("anchor", key), ["anchor", key]).select(*KEY, at.alias("at")))
    return whole.groupBy(*KEY).agg(F.collect_set("at").alias("at"))


def _by_heat(counts: DataFrame, key: str) -> tuple[DataFrame, list]:
    """``counts`` (key, n, ...) without its hot keys, and the rows of those: each has over one in ``HOT`` of all that is counted,
    so there are fewer than ``HOT``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total).collect()
    return counts.where(F.col("n") * HOT <= total), hot


def _among(key: str, values: list[int]) -> Column:
    return F.col(key).isin(values) if values else F.lit(False)


def removed(n_words: int, at: np.ndarray | None, window: int = WINDOW) -> np.ndarray:
    """A mask of the words that repeated windows cover."""
    if at is None or not len(at):
        return np.zeros(n_words, bool)
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at >> 6, 1)
    np.add.at(step, (at >> 6) + (at & 63) + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _with_repeats(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """row (all columns of ``docs``, so that no name clashes) and at, its runs of repeated windows or null."""
    at = stash(repeated_windows(docs, window, seed_words), "repeats")
    return docs.select(F.struct("*").alias("row"), *_key("doc_id", "text")).join(at, KEY, "left").select("row", "at")


def substring_digest(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of ``docs``.

    A null text has no words; its digest is that of the empty string, as is that of a text all of whose words go. Texts of
    fewer words than the window have no window and stay whole. Repeated rows are documents of their own: their windows repeat.
    Null ids are returned as they are. Extra columns are ignored; an empty table gives an empty result.
    """

    @F.arrow_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pa.Array, ats: pa.Array) -> pa.Array:
        n, gone, sha = [], [], []
        for text, at in zip(texts, ats):
            words = [w for part in word_lists((text.as_py() or "").encode()) for w in part]
            mask = removed(len(words), at.values.to_numpy() if at.is_valid else None, window)
            kept = [w for w, m in zip(words, mask.tolist()) if not m] if mask.any() else words
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept_sha256"])

    rows = _with_repeats(docs.select("doc_id", "text"), window, seed_words)
    return rows.select("row.doc_id", digest("row.text", "at").alias("d")).select("doc_id", "d.*")


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, first_word, end_word: the maximal runs of words that repeated windows cover, words from 0."""

    @F.arrow_udf("array<struct<first_word: long, end_word: long>>")
    def runs(ats: pa.Array) -> pa.Array:
        out = []
        for at in ats:
            x = at.values.to_numpy()
            edge = np.diff(np.concatenate([[False], removed(int((x >> 6).max()) + 64 + window, x, window), [False]]).astype(np.int8))
            out.append([{"first_word": a, "end_word": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
        return pa.array(out, pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())])))

    rows = _with_repeats(docs.select("doc_id", "text"), window, seed_words).where("at is not null")
    return rows.select("row.doc_id", F.explode(runs("at")).alias("r")).select("doc_id", "r.*")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: str, at: np.ndarray, window: int = WINDOW) -> str:
    """The text without its repeated words; what stands between the words that stay is kept as it is."""
    data = text.encode()
    spans = [m.span() for m in _WORD.finditer(data)]
    mask = removed(len(spans), at, window)
    out, start = [], 0
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        out.append(data[start : spans[a][0]])
        start = spans[b][0] if b < len(spans) else len(data)
    return b"".join([*out, data[start:]]).decode()


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages cut from the texts and n_chars, if there, counted again."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, ats: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not a.is_valid or not t.is_valid else without_words(t.as_py(), a.values.to_numpy(), window) for t, a in zip(texts, ats)], pa.string())

    rows = _with_repeats(docs, window, seed_words)
    row = F.col("row").withField("text", cut("row.text", "at"))
    if "n_chars" in docs.columns:
        same = F.col("at").isNull() | F.col("row.text").isNull()
        row = row.withField("n_chars", F.when(same, F.col("row.n_chars")).otherwise(F.length(row["text"]).cast(docs.schema["n_chars"].dataType)))
    return rows.select(row.alias("row")).select("row.*")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 35 words and more in all documents: doc_id, n_words, n_removed, kept_sha256."""
    return substring_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT s.r, s.i, sha256(array_to_string(d.w[s.i:s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT r, i + k AS p FROM t, (SELECT unnest(range(0, 35)) AS k)),
p AS (SELECT r, count(*) AS c, list(p) AS ps FROM x GROUP BY r),
k AS (SELECT r, list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(ps, i), false)) AS ks FROM d LEFT JOIN p USING (r))
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - len(k.ks) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(k.ks, lambda i: d.w[i]), ' ')) AS kept_sha256
FROM d JOIN k USING (r)
"""
