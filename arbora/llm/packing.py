"""Packing of token sequences by power-of-two decomposition: no sequence crosses documents, no padding."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CONTEXT = 4096
END_ID = 2
#: About how many bytes of words and their ids a Python worker keeps; beyond that it starts anew, which costs time and changes
#: nothing. A word counts as ``WORD_BYTES`` more than its own bytes and its ids, at most one for each byte.
CACHED_BYTES = 80_000_000
WORD_BYTES = 200

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the fast path below is written for (fixed values): the tokenizer's pattern of words, and the mark of a word's end.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Words of visible ASCII and Latin-1 letters: their normal form is their lower case, and these are their parts.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_END, _NEXT = "\x01", "\n"


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, then from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_encoder(path: str) -> Callable[[str], list[int]] | None:
    """An encoder of marked words with the same merges: a part's last byte carries the mark of the word's end, which gives way
    to a byte of its own here. None for a file of another form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"].get("end_of_word_suffix") != WORD_END or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") != WORD_PATTERN:
        return None
    import tiktoken

    chars, special = _byte_chars(), {t["id"] for t in spec["added_tokens"]}
    ranks = {}
    for token, rank in spec["model"]["vocab"].items():
        if rank not in special:
            core, end = (token[: -len(WORD_END)], _END.encode()) if token.endswith(WORD_END) else (token, b"")
            ranks[bytes(chars[c] for c in core) + end] = rank
    return tiktoken.Encoding("words", pat_str=f"[^{_END}{_NEXT}]+{_END}|{_NEXT}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordTokenizer:
    """Token ids of whole texts, word by word.

    This tokenizer drops white space and merges nothing across it, so a text's ids are those of its blank-separated words in
    order. Most words are seen again and again: each is encoded once and kept as little-endian 32-bit ids. New words of ASCII
    and Latin-1 letters go through an encoder that skips the general normalisation; the rest through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = _plain_encoder(path)
        if self.plain:
            (self.next_id,) = self.plain(_NEXT)
        self.known: dict[bytes, bytes] = {}
        self.used = 0

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        lists = [t.split() for t in texts]
        new = set().union(*lists).difference(self.known)
        cost = lambda: WORD_BYTES * len(new) + 5 * sum(map(len, new))
        if self.used + cost() > CACHED_BYTES:
            self.known, self.used = {}, 0
            new = set().union(*lists)
        self.used += cost()
        words, rest = [], []
        for w in new:
            text = w.decode()
            (words if self.plain and _PLAIN.fullmatch(text) and "<|" not in text else rest).append(text)
        if words:
            ids = np.array(self.plain(_PARTS.sub(r"\g<0>" + _END, _NEXT.join(words).lower())), "<u4")
            cuts = np.flatnonzero(ids == self.next_id)
            raw = ids.tobytes()
            for w, a, b in zip(words, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]):
                self.known[w.encode()] = raw[a:b]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w.encode()] = np.array(e.ids, "<u4").tobytes()
        for line in lists:
            yield b"".join(map(self.known.__getitem__, line))


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def powers_of_two(n: int, limit: int) -> list[int]:
    """Piece lengths for ``n`` tokens: as many of ``limit`` as fit, then the binary digits of the rest, largest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _groups(texts: Iterable[bytes], size: int = 1 << 21) -> Iterator[list[bytes]]:
    group, total = [], 0
    for t in texts:
        group.append(t)
        total += len(t)
        if total >= size:
            yield group
            group, total = [], 0
    yield group


def _packer(path: str, context: int, end_id: int, keep_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for group in _groups((t.as_py() or "").encode() for t in batch.column(1)):
                rows: list[list] = [[] for _ in range(6 + keep_ids)]
                for data in tok.encode(group):
                    doc_id, data, start = next(ids), data + end, 0
                    for length in powers_of_two(len(data) // 4, context):
                        piece = data[4 * start : 4 * (start + length)]
                        for x, y in zip(rows, (doc_id, start, length, zlib.crc32(piece), len(data) // 4, length.bit_length() - 1, piece)):
                            x.append(y)
                        start += length
                types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * keep_ids)

    return run


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, and ids if asked for.

    A document's ids, with ``end_id`` after them, are cut into pieces of ``context`` and, for the rest, the powers of two of its
    binary form; every piece is a sequence of its own, and ``bucket`` (the length's logarithm) groups those of equal length, so
    that a batch from one bucket has no padding and no sequence holds two documents. This needs no shuffle.

    A null or empty text is one piece that holds ``end_id``. Null ids come back null, repeated rows are packed again.
    ``sequence_id`` is unique in the result, not dense. Extra columns are ignored. ``ids`` is little-endian unsigned 32-bit.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(path or word_bpe_path(), context, end_id, keep_ids), PIECE + (", ids binary" if keep_ids else ""))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, each a power of two of tokens from one document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
