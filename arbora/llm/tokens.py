"""Token counts of sections and fields: whole texts are encoded once, tokens are attributed by their offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a token that crosses a boundary is allocated: to the section of its first byte; to the section with most of its bytes,
#: the earliest of those with equally many; or to all its sections in proportion to their bytes.
RULES = ("first", "most", "share")

#: Lines that leave a task together; a text of more lines leaves on its own.
BATCH_LINES = 100_000

SECTION = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encoding function of a byte-level BPE, and the length in bytes of each token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def allocate(ends: np.ndarray, sizes: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of each that cross its boundary) for tokens and sections laid end to end.

    ``ends`` are the sections' end bytes, ascending, the last one the text's; ``sizes`` the tokens' lengths. Both sides are
    sorted, so the interval join is a binary search: a token meets the sections from that of its first byte to that of its last.
    """
    stop = np.cumsum(sizes)
    start = stop - sizes
    one, two = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right")
    cross = np.flatnonzero(one != two)
    count = np.bincount(one[one == two], minlength=len(ends)).astype(np.float64)
    crossing = np.zeros(len(ends), np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    for t in cross.tolist():
        sections = np.arange(one[t], two[t] + 1)
        part = np.minimum(ends[sections], stop[t]) - np.maximum(begins[sections], start[t])
        crossing[sections[part > 0]] += 1
        if rule == "share":
            count[sections] += part / part.sum()
        else:
            count[sections[0 if rule == "first" else int(part.argmax())]] += 1
    return count, crossing


def line_ends(data: bytes) -> np.ndarray:
    """End bytes of the lines of a text, line feeds included; one empty section for an empty text."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


def _chars(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Byte offsets that lie between characters as character offsets."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[ends]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    ids, *cols = zip(*parts) if parts else [()] * 7
    lines = [len(c) for c in cols[0]]
    doc_ids = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), lines)))
    kinds = (np.int32, np.int64, np.int64, np.float64, np.int64, np.int64)
    arrays = [pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t, copy=False)) for c, t in zip(cols, kinds)]
    return pa.RecordBatch.from_arrays([doc_ids, *arrays], [c.split()[0] for c in SECTION.split(", ")])


def _counter(path: str, rule: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(path)
        for batch in batches:
            parts, lines = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                data, ids = text.encode(), np.array(encode(text), np.int64)
                ends = line_ends(data)
                stops, n = _chars(data, ends), len(ends)
                parts.append((doc_id, np.arange(n), np.append(0, stops[:-1]), stops, *allocate(ends, sizes[ids], rule), np.full(n, len(ids))))
                lines += n
                if lines >= BATCH_LINES:
                    yield _batch(parts)
                    parts, lines = [], 0
            yield _batch(parts)

    return run


def section_token_counts(docs: DataFrame, rule: str = "most", path: str | None = None) -> DataFrame:
    """One row for each line of each text: doc_id, section (from 0), start and end (characters), n_tokens, n_crossing, doc_tokens.

    A text is encoded once, as a whole; its tokens' bytes laid end to end are the text's, which gives their offsets. ``n_tokens``
    of a text's sections sum to ``doc_tokens`` under every rule of ``RULES``. A null or empty text has one empty section without
    tokens. Null ids and repeated rows are counted as they come; extra columns are ignored. There is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(path or byte_bpe_path(), rule), SECTION)


def field_token_counts(rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "most", path: str | None = None) -> DataFrame:
    """``rows`` with array<double> ``field_tokens``: tokens of each string field when a row is encoded as one joined text.

    A separator belongs to the field before it; null fields count as empty. The row's other columns stay; a column of the
    result's name is replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or byte_bpe_path()

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        encode, sizes = encoder(path)
        out = []
        for values in zip(*(c.to_pylist() for c in columns)):
            parts = [(v or "") + separator for v in values[:-1]] + [values[-1] or ""]
            ends = np.cumsum([len(p.encode()) for p in parts])
            out.append(allocate(ends, sizes[np.array(encode("".join(parts)), np.int64)], rule)[0].tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return rows.withColumn("field_tokens", run(*[F.col(f) for f in fields]))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of each line of all documents."""
    return section_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
