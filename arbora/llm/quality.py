"""Quality scores from compression: how much better text packs with a dictionary of good text than with one of bad text."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that are compressed at once; each piece of a text meets the fresh dictionary, so long texts don't outgrow it.
PIECE_BYTES = 4096
DICT_BYTES = 200_000
#: Bounds of the sample of labelled rows from which a model is fitted: documents and pieces for each dictionary, documents for
#: calibration.
DICT_PIECES = 3000
CALIBRATION_DOCS = 4000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """``score = 1 / (1 + exp(-(weights[0] * difference + weights[1] * level + weights[2])))``, see ``features``."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


@lru_cache(8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def pieces(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), PIECE_BYTES):
        yield data[at : at + PIECE_BYTES]


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """(difference, level) of a whole text, over all its pieces; (0, 0) for an empty one.

    difference: bytes that the bad dictionary needs beyond the good one, for each byte of text. level: log of the mean of both
    sizes for each byte. Text that repeats itself packs so well with either that the difference alone says little of it.
    """
    g, b = _compressor(good), _compressor(bad)
    data = (text or "").encode()
    x = y = 0
    for part in pieces(data):
        x += len(g.compress(part))
        y += len(b.compress(part))
    return ((y - x) / len(data), math.log((x + y) / 2 / len(data))) if data else (0.0, 0.0)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Weights of a logistic regression on the columns of ``x``, then the intercept, by Newton's method on scaled columns."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    own = w[:-1] / scale
    return (*map(float, own), float(w[-1] - own @ mean))


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def feature_column(text: str, good: bytes, bad: bytes) -> Column:
    """struct<difference, level>"""

    @F.arrow_udf("difference double, level double")
    def run(texts: pa.Array) -> pa.Array:
        rows = [features(t.as_py(), good, bad) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)], ["difference", "level"])

    return run(F.col(text))


def _cutter(most: int) -> Callable:
    """label, doc_id, nth, piece for rows (label, doc_id, text): all pieces of a document, or ``most`` of them by a hash, as no
    more are wanted of its label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for label, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = ((zlib.crc32(f"{doc}:{i}".encode()), i, part) for i, part in enumerate(pieces((text or "").encode())))
                rows += [(label, doc, i, part) for _, i, part in heapq.nsmallest(most, parts)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["label", "doc_id", "nth", "piece"])

    return run


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label: one row for each document that ``labels`` calls good (1) or bad (0), and never both; rows that repeat count
    once, rows that contradict each other count for nothing, nor do null ids and other values."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    return rows.agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("high")).where("label = high").select("doc_id", "label")


def train(docs: DataFrame, labels: DataFrame, dict_pieces: int = DICT_PIECES, calibration_docs: int = CALIBRATION_DOCS) -> QualityModel | None:
    """Fit on labelled rows (see ``usable_labels``) outside the held-out fold; None if either label has no text there.

    The rows split by a hash of the id: three quarters give pieces for the dictionaries (as many documents of either label at
    most), one quarter, in its natural mix, calibrates. Each sample is bounded and is the rows with the smallest hashes, so it
    doesn't depend on partitioning; only the labels of sampled rows are broadcast.
    """
    wanted = usable_labels(labels).where(~held_out()).withColumn("h", F.xxhash64(F.lit("quality"), "doc_id"))
    one, two = (wanted.where(f"label = {k}").orderBy("h", "doc_id").limit(dict_pieces) for k in (0, 1))
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(one.unionByName(two)), "doc_id")  # bounded by dict_pieces
    cut = rows.where("h & 3 <> 0").select("label", "doc_id", "text").mapInArrow(_cutter(dict_pieces), "label int, doc_id long, nth int, piece binary")
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "nth"), "doc_id", "nth")
    got = cut.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= dict_pieces).orderBy("label", "rank").select("label", "piece").collect()
    sample = {k: [bytes(r[1]) for r in got if r[0] == k] for k in (0, 1)}
    if not all(sample.values()):
        return None
    size = min(DICT_BYTES, min(sum(map(len, s)) for s in sample.values()) // 8)
    good, bad = (_dictionary(sample[k], size) for k in (1, 0))
    mixed = wanted.where("h & 3 = 0").orderBy("h", "doc_id").limit(calibration_docs)
    calibration = docs.select("doc_id", "text").join(F.broadcast(mixed), "doc_id")  # bounded by calibration_docs
    got = calibration.select("label", feature_column("text", good, bad).alias("x")).select("label", "x.*").toPandas()
    if got["label"].nunique() < 2:
        return QualityModel(good, bad, (100.0, 0.0, 0.0))
    return QualityModel(good, bad, logistic_fit(got[["difference", "level"]].to_numpy(), got["label"].to_numpy(float)))


def _dictionary(sample: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the plain text as one where the sample is too small to train on."""
    try:
        return zstandard.train_dictionary(max(size, 256), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def score_column(text: str, model: QualityModel | None) -> Column:
    """The calibrated score, 0 to 1; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)
    x = feature_column(text, model.good, model.bad)
    z = F.lit(model.weights[2]) + F.lit(model.weights[0]) * x["difference"] + F.lit(model.weights[1]) * x["level"]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``, from whole texts alone.

    Null and empty texts have features 0 and so the score of the intercept. Null ids are scored and never learned from.
    Repeated rows are scored alike. If labels of one kind are missing, every score is 0.5. Extra columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept."""
    model = train(docs, labels)
    return docs.where(score_column("text", model) >= threshold)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents as the labels mark it: doc_id, held_out, score, predicted."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
