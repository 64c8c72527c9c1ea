"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.words import blocks

BUCKET_BITS = 16
DIM = 16
PIECE_BYTES = 600
#: Bounds of the sample of rows from which a model is fitted: pieces for the embeddings, documents for calibration. Every
#: language has at least ``LEAST_PIECES`` (if its rows have them), however many languages there are.
TRAIN_PIECES = 6000
CALIBRATION_DOCS = 4000
LEAST_PIECES = 100
EPOCHS = 3
#: A prediction is rejected if so small a share of the right calibration predictions has so little confidence.
REJECTED_SHARE = 0.001
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(data: bytes) -> np.ndarray:
    """Buckets of all runs of 2, 3 and 4 bytes of the letters, with one space around each word."""
    text = b" ".join(data.translate(_BLANKED).split())
    if not text:
        return np.zeros(0, np.int64)
    a = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] | a[1:] << np.uint32(8)
    three = two[:-1] | a[2:] << np.uint32(16)
    four = three[:-1] | a[3:] << np.uint32(24)
    mixed = [(g ^ np.uint32(n * 0x27D4EB2F)) * np.uint32(2654435761) for n, g in enumerate((two, three, four))]
    return (np.concatenate(mixed) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """``votes[bucket]`` is the embedding times the softmax weights, so a text's logits are the mean of its votes, plus bias."""

    languages: tuple[str, ...]
    votes: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in blocks(text.encode(), 1 << 18):
            ids = subwords(part)
            total += self.votes[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias


def train_embeddings(ids: list[np.ndarray], y: np.ndarray, n_classes: int, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on single pieces; returns votes and bias."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out, bias = np.zeros((n_classes, DIM)), np.zeros(n_classes)
    counted = [np.unique(x, return_counts=True) for x in ids]
    steps, done = epochs * len(ids), 0
    for _ in range(epochs):
        for i in rng.permutation(len(ids)):
            at, n = counted[i]
            share = n / n.sum()
            hidden = share @ emb[at]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - done / steps)
            back = out.T @ p
            out -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            emb[at] -= (lr * len(at) ** 0.5) * share[:, None] * back
            done += 1
    return (emb @ out.T).astype(np.float32), bias


def calibrate(z: np.ndarray, y: np.ndarray, share: float = REJECTED_SHARE) -> tuple[float, float]:
    """The temperature with the least log loss, and the confidence that all but ``share`` of the right predictions reach.

    The latter is one half at most: a prediction that is likelier right than wrong is never rejected.
    """

    def soft(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.02, 20, 80)
    loss = [-np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = soft(t)
    right = p.argmax(axis=1) == y
    return t, min(0.5, float(np.quantile(p.max(axis=1)[right], share))) if right.any() else 0.0


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _cutter(each: int) -> Callable:
    """lang, doc_id, nth, piece for rows (lang, doc_id, text): all pieces of a document, or ``each`` of them by a hash, as no more
    are wanted of its language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lang, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = ((zlib.crc32(f"{doc}:{i}".encode()), i, part) for i, part in enumerate(blocks((text or "").encode(), PIECE_BYTES)))
                rows += [(lang, doc, i, part) for _, i, part in heapq.nsmallest(each, parts)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], ["lang", "doc_id", "nth", "piece"])

    return run


def _logits(text: str, model: LanguageModel) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.logits(t.as_py() or "").tolist() for t in texts], pa.list_(pa.float64()))

    return run(F.col(text))


def train(docs: DataFrame, train_pieces: int = TRAIN_PIECES, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModel | None:
    """Fit on rows with a language outside the held-out fold; None if there are none.

    The languages are counted first, all of them; then each gives about the same number of documents, chosen by a hash of the
    id, so that the sample is bounded and doesn't depend on partitioning. Three quarters of them give pieces for the embeddings,
    one calibrates.
    """
    rows = docs.where(F.col("lang").isNotNull() & (fold() != 2)).select("doc_id", "lang", "text", F.xxhash64(F.lit("lang"), "doc_id").alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    languages = tuple(sorted(counts))
    if not languages:
        return None
    each = max(train_pieces // len(languages), LEAST_PIECES)
    wanted = [(k, min(1.0, 2 * (each + calibration_docs / len(languages)) / counts[k])) for k in languages]
    rates = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, rate double"))  # one row for each language
    share = (F.shiftrightunsigned("h", 12) % (1 << 24)) / F.lit(float(1 << 24))
    some = rows.join(rates, "lang").where(share < F.col("rate")).select("doc_id", "lang", "text", "h")
    cut = some.where("h & 3 <> 0").select("lang", "doc_id", "text").mapInArrow(_cutter(each), "lang string, doc_id long, nth int, piece binary")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "nth"), "doc_id", "nth")
    got = cut.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each).orderBy("lang", "rank").select("lang", "piece").collect()
    sample = [(r[0], subwords(bytes(r[1]))) for r in got]
    sample = [(k, x) for k, x in sample if len(x)]
    code = {k: i for i, k in enumerate(languages)}
    votes, bias = train_embeddings([x for _, x in sample], np.array([code[k] for k, _ in sample], int), len(languages)) if sample else (np.zeros((1 << BUCKET_BITS, len(languages)), np.float32), np.zeros(len(languages)))
    model = LanguageModel(languages, votes, bias)
    held = some.where(F.expr("h & 3 = 0") & F.col("text").rlike(r"\p{L}")).orderBy("h", "doc_id").limit(calibration_docs)
    got = held.select("lang", _logits("text", model).alias("z")).toPandas()
    if not len(got):
        return model
    return LanguageModel(languages, votes, bias, *calibrate(np.array(got["z"].tolist()), got["lang"].map(code).to_numpy()))


def predict_column(text: str, model: LanguageModel | None) -> Column:
    """struct<lang_pred, score, accepted>: ``und``, 0 and false for null texts, those without a letter, or without a model."""

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def run(texts: pa.Array) -> pa.Array:
        pred, score, ok = [], [], []
        for t in texts:
            t = t.as_py()
            if model is None or t is None or not _LETTER.search(t):
                pred.append(UNDETERMINED)
                score.append(0.0)
            else:
                z = model.logits(t) / model.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                pred.append(model.languages[int(p.argmax())])
                score.append(float(p.max()))
            ok.append(pred[-1] != UNDETERMINED and score[-1] >= model.threshold)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["lang_pred", "score", "accepted"])

    return run(F.col(text))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: one row for each row of ``docs``, from whole texts alone.

    ``score`` is the calibrated probability of the prediction; ``accepted`` is false where it is below the calibrated
    threshold. Null texts and texts without a letter are ``und`` with score 0. Null ids are predicted and not learned from.
    Repeated rows get the same prediction; extra columns are ignored; without any language to learn all is ``und``.
    """
    model = train(docs)
    rows = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), predict_column("text", model).alias("p"))
    return rows.select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with enough confidence, all columns kept."""
    return docs.where(predict_column("text", train(docs))["accepted"])


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents: doc_id, held_out, lang_pred, score, accepted."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
