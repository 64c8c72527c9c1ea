"""Importance resampling towards a target: hashed word n-grams, counted and weighed by Arrow kernels."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.rank import global_rank
from arbora.plans import stash

BUCKETS = 10_000
WIDTH = 3
SEED = 42
#: Documents of fewer words are never drawn; of the others this share, in hundredths, is.
MIN_WORDS = 20
PERCENT = 5

#: Texts meet the kernels in slices of about this many bytes; a longer text is cut between words.
SLICE_BYTES = 1 << 20

#: What separates words: all ASCII characters but letters and digits (capitals are lowered before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_SPACE = np.uint32(zlib.crc32(b" "))


@lru_cache(1)
def _byte_step() -> np.ndarray:
    """What the polynomial division adds for each value of the byte that leaves the register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


@lru_cache(4096)
def _zeros(n: int) -> np.ndarray:
    """The register after ``n`` more zero bytes, as one table for each of its four bytes: the step is linear."""
    if n == 0:
        c = np.arange(256, dtype=np.uint32)
        return np.stack([c << np.uint32(8 * i) for i in range(4)])
    if n == 1:
        c = _zeros(0)
        return (c >> 8) ^ _byte_step()[c & 255]
    return _through(_zeros(n - n // 2), _zeros(n // 2))


def joined_crc(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each left text followed by each right text, from their own CRCs and the right ones' lengths in bytes."""
    out = np.empty_like(left)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = _through(_zeros(n), left[at])
    return out ^ right


def features(texts: pa.Array, context: np.ndarray, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], pa.Array]:
    """(words of each text, [(text, bucket) of the n-grams] for n = 1..width, all words).

    The first ``context`` words of a text are only what stands before it: n-grams that end there are left out.

    Words become dictionary indices. The index of an n-gram's first n - 1 words, times the number of distinct words, plus that
    of its last word names the n-gram; the distinct names get their CRC from the CRCs of both parts, and ``take`` hands it to
    every place.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    words, owner = flat.filter(some), owner.filter(some).to_numpy()
    count = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    encoded = words.dictionary_encode()
    word, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.cast(pa.large_binary())
    word_crc = np.fromiter(map(zlib.crc32, names.to_pylist()), np.uint32, len(names))
    word_bytes = pc.binary_length(names).to_numpy()
    fresh, out = place >= context[owner], []
    gram, crc = word, word_crc  # of the n-gram that starts at each word; of each distinct n-gram
    for n in range(1, width + 1):
        if n > 1:
            whole = np.flatnonzero(place[n - 1 :] >= n - 1)  # starts of n-grams inside a text
            encoded = pa.array(gram[whole] * len(names) + word[whole + n - 1]).dictionary_encode()
            first, last = np.divmod(encoded.dictionary.to_numpy(), max(1, len(names)))
            spaced = joined_crc(crc, np.full(len(crc), _SPACE), np.ones(len(crc), np.int64))
            crc = joined_crc(spaced[first], word_crc[last], word_bytes[last])
            gram = np.zeros(len(word), np.int64)
            gram[whole] = encoded.indices.to_numpy()
        else:
            whole = np.arange(len(word))
        whole = whole[fresh[whole + n - 1]]
        bucket = pa.array((crc % np.uint32(buckets)).astype(np.int64)).take(pa.array(gram[whole])).to_numpy()
        out.append((owner[whole], bucket))
    return count - np.minimum(context, count), out, words


def slices(texts: pa.Array, width: int = WIDTH, size: int | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray, Callable]]:
    """(first row, texts, words of context, what to call with the words found): rows in order, a long text in several steps."""
    size = size or SLICE_BYTES
    texts = texts.cast(pa.large_string()).fill_null("")
    length, start, nothing = pc.binary_length(texts).to_numpy(), 0, lambda words: None
    while start < len(texts):
        end = start + max(1, int(np.searchsorted(np.cumsum(length[start:]), size, side="right")))
        if length[start] <= size:
            yield start, texts.slice(start, end - start), np.zeros(end - start, np.int64), nothing
        else:
            data, at, before = texts[start].as_py().encode(), 0, []
            while at < len(data):
                cut = _SEPARATOR.search(data, min(len(data), at + size))
                cut = cut.start() if cut else len(data)
                piece = " ".join([*before, data[at:cut].decode()])
                yield start, pa.array([piece], pa.large_string()), np.array([len(before)]), (lambda words, b=before: b.extend(words.slice(max(0, len(words) - width + 1)).to_pylist()))
                before[: max(0, len(before) - width + 1)] = []
                at = cut
            end = start + 1
        start = end


def counts(texts: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many n-grams of all rows fall into each bucket. A task sends one row for each bucket at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part, context, seen in slices(batch.column(0), width):
                _, grams, words = features(part, context, width, buckets)
                seen(words)
                for _, bucket in grams:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, a thousand times the log of how much likelier the target is to use it, one feature of each bucket added
    to both sides; whole numbers, rounded down. What reaches the driver is two numbers for each bucket."""
    both = []
    for table in (docs, target):
        n = [0] * buckets
        for r in counts(table, text_col, width, buckets).collect():
            n[r["bucket"]] = r["n"]
        both.append(n)
    source, wanted = both
    s_all, t_all = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, wanted)], np.int64)


def weigh(text: Column, gain: np.ndarray, width: int = WIDTH) -> Column:
    """struct<n_words, n_features, weight> of a text: its words, its n-grams, and the sum of their buckets' gains."""

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for first, part, context, seen in slices(texts, width):
            n, grams, words = features(part, context, width, len(gain))
            seen(words)
            out[0, first : first + len(part)] += n
            for owner, bucket in grams:
                edge = np.searchsorted(owner, np.arange(len(part) + 1))  # owners ascend: each text is one segment
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                out[1, first : first + len(part)] += np.diff(edge)
                out[2, first : first + len(part)] += np.diff(total[edge])
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_words", "n_features", "weight"])

    return run(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand Gumbels' worth of noise, rounded down, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs``), id, n_words, n_features, weight, score: one row for each row of ``docs``."""
    gain = gains(docs, target, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), weigh(F.col(text_col), gain).alias("w"))
    return rows.select("row", "id", "w.*").withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _order() -> list[Column]:
    return [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("id")]


def ranks(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` (id, n_words, score, ...) with rank: 1, 2, 3, ... for the drawn rows, null for all others.

    Of the N rows of at least ``min_words`` words, floor(N * percent / 100) are drawn: the highest scores, ties to the smaller
    id, rows without an id last. Rows that agree in both are told apart in any order.
    """
    able = stash(rows.withColumn("drawable", F.col("n_words") >= min_words), "scored", release=False)  # ranges are sampled: not weighed twice
    out = stash(global_rank(able, _order(), "place"), "ranked", release=False)
    size = out.where("drawable").count() * percent // 100
    return out.withColumn("rank", F.when(F.col("drawable") & (F.col("place") <= size), F.col("place"))).drop("drawable", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text, ...), with its columns.

    Sampling without replacement, in proportion to exp(weight / 1000): the highest weights plus Gumbel noise are drawn, so the
    draw leans towards texts whose n-grams the target (text, ...) uses more than ``docs`` does. Null texts have no words and are
    never drawn unless ``min_words`` is 0; rows without an id share the noise of an empty id. Repeated rows are drawn one by
    one. Extra columns, whatever their names, are kept; an empty table gives an empty result, an empty target equal chances.

    Texts are read three times (counted, weighed for the ranks, weighed for the rows that reach the last rank's score); only
    ids and numbers are shuffled.
    """
    rows = scored(docs, target, seed).where(F.col("n_words") >= min_words)
    drawn = ranks(rows.select("id", "n_words", "score"), percent, min_words).where("rank is not null")
    last = drawn.agg(F.min("score"), F.count(F.lit(1))).first()
    if not last[1]:
        return docs.limit(0)
    above = rows.where(F.col("score") > last[0]).select("row")
    tied = global_rank(rows.where(F.col("score") == last[0]).select("row", "id"), [F.asc_nulls_last("id")], "place")
    room = last[1] - drawn.where(F.col("score") > last[0]).count()
    return above.unionByName(tied.where(F.col("place") <= room).select("row")).select("row.*")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Draw of all documents towards the benchmark's texts: doc_id, n_features, weight, score, rank."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = scored(docs.select("doc_id", "text"), target).select("id", "n_words", "n_features", "weight", "score")
    return ranks(rows).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH t AS (SELECT list_reduce(range(0, 8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v, b FROM (SELECT unnest(range(0, 256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS v FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT -row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT r, w FROM d UNION ALL SELECT r, w FROM m),
g AS (SELECT r, unnest(w) AS f FROM a UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM a
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM a),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
  lambda c, b: xor(c // 256, tab.v[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS k FROM u, tab),
b AS (SELECT k, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM g JOIN c USING (f) GROUP BY k),
n AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
e AS (SELECT k, CAST(floor(1000 * ln((b.t + 1.0::DOUBLE) * (n.s + 10000)::DOUBLE / ((b.s + 1.0::DOUBLE) * (n.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b, n),
q AS (SELECT r, count(*) AS nf, sum(gain) AS weight FROM g JOIN c USING (f) JOIN e USING (k) WHERE r > 0 GROUP BY r),
z AS (SELECT d.r, doc_id, len(w) AS n_words, CAST(coalesce(nf, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN q USING (r)),
o AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * many // 100 THEN place END AS rank FROM o
"""
