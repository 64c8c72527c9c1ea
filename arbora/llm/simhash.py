"""Near-duplicate documents by SimHash fingerprints, linked through pigeonring filtering."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.graph import components
from arbora.llm.words import word_lists
from arbora.plans import stash

BITS = 64
SEED = 42


def _shingle_hashes(text: str, width: int):
    carry: list[bytes] = []
    whole = True  # no shingle so far
    for words in word_lists(text.encode().lower()):
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)
            carry = words[len(words) - width + 1 :]
            whole = False
        else:
            carry = words
    if whole and carry:  # fewer words than a shingle has: the whole sequence is the only shingle
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer.

    ASCII capitals are lowered (``bytes.lower`` touches no other byte), words are runs of non-blank bytes, and a bit is set
    if it is set in over half of the XXH64 hashes of the ``width``-word shingles, repeats included. A text of fewer words is
    one shingle; a null text or one without words has fingerprint zero.
    """
    total, ones = 0, np.zeros(BITS, np.int64)
    for h in _shingle_hashes(text or "", width):
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long, digest long (a hash of the text): one row for each row of ``docs``; other columns are not read."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"), F.xxhash64(F.col(text_col)).alias("digest"))


def _rotated(fp: Column, left: int) -> Column:
    return fp if left == 0 else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, BITS - left))


def links(fps: DataFrame, distance: int = 3, segments: int = 4) -> DataFrame:
    """a, b: pairs of ids of distinct fingerprints (columns fp, id) that differ in at most ``distance`` bits.

    Pigeonring: lay the segments on a ring. If all differences sum to at most ``distance``, some segment starts a chain whose
    first l segments differ in at most floor(l * distance / segments) bits, for every l. With 4 segments of 16 bits and
    distance 3 these budgets are 0, 1, 2, 3. The join key holds the first two budgets: the first segment is equal, and the
    second is equal after at most one set bit of one side is cleared; so a key has 32 bits and a fingerprint has about 36
    keys. The longer chains are then checked, and last the full distance. No bound is put on the partners of a fingerprint;
    as fingerprints are distinct, there are 43,744 others within 3 bits at most, so links don't grow with a group's square. The
    join is merged: Spark takes the exploded sides for as small as the file of ``fps`` and would broadcast them from the driver.
    """
    width = BITS // segments
    budget = [(i + 1) * distance // segments for i in range(segments)]
    if BITS % segments or segments > distance + 1 or budget[0] != 0 or segments < 2 or budget[1] > 1 or 2 * width > 58:
        raise ValueError("segments must divide 64 and leave budgets of 0 and at most 1 for the first two of a chain")
    ring = F.posexplode(F.array(*[_rotated(F.col("fp"), width * i) for i in range(segments)])).alias("seg", "rot")
    index = fps.select("id", ring).select("id", "rot", (F.col("seg").cast("long") * (1 << 2 * width) + F.shiftrightunsigned("rot", BITS - 2 * width)).alias("key"))
    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(width)])
    cleared = F.filter(bits, lambda b: F.col("key").bitwiseAND(b) != 0)
    keys = F.concat(F.array(F.col("key")), F.transform(cleared, lambda b: F.col("key") - b)) if budget[1] else F.array(F.col("key"))
    probe = index.select(F.col("id").alias("pid"), F.col("rot").alias("prot"), F.posexplode(keys).alias("nth", "key"))
    diff = F.col("rot").bitwiseXOR(F.col("prot"))
    cond = (F.col("nth") > 0) | (F.col("pid") < F.col("id"))
    for i in range(2, segments):
        cond = cond & (F.bit_count(F.shiftrightunsigned(diff, BITS - width * (i + 1)) if i + 1 < segments else diff) <= budget[i])
    return index.join(probe.hint("merge"), "key").where(cond).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b"))


def _groups(fps: DataFrame, distance: int) -> DataFrame:
    """fp, node, component_id: for each distinct fingerprint the smallest one that links reach, and the smallest id among them.

    These tables grow with the documents, so here and below their joins are merged, not broadcast from the driver.
    """
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct_fingerprints")
    comp = components(links(distinct.select(F.col("fp").alias("id"), "fp"), distance))
    rows = stash(distinct.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("node")), "node_of_fingerprint")
    first = stash(rows.groupBy("node").agg(F.min("doc_id").alias("component_id")), "component_of_node")
    return stash(rows.select("fp", "node").join(first.hint("merge"), "node"), "component_of_fingerprint")


def simhash_groups(docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``.

    Rows with equal fingerprints are one node, so groups of copies cost one row in the candidate search. ``component_id`` is
    the smallest id that links reach. Null and blank texts share fingerprint zero and are linked like any others. A row with a
    null id is returned and links through its fingerprint; its component is null if no row there has an id. Rows that share an
    id are told apart by their fingerprints, repeated rows come back repeated. Extra columns are ignored; an empty table gives
    an empty result.
    """
    fps = stash(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return fps.join(_groups(fps, distance).hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """One row of each near-duplicate group of ``docs`` (doc_id, text, ...), all its columns kept.

    It is the one of the smallest id (rows without an id come last), then of the smallest hash of the text; of rows that agree
    in both any one. So rows that repeat, and rows without an id, are copies like others.
    """
    fps = stash(fingerprints(docs, width), "fingerprints")
    rows = fps.join(_groups(fps, distance).select("fp", "node").hint("merge"), "fp").groupBy("node", "doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "times")).alias("best"))
    best = stash(best.select("best.*"), "kept_documents")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("digest"))
    once = keyed.join(best.where("times = 1").hint("merge"), same, "left_semi").select("row.*")
    more = keyed.join(best.where("times > 1").hint("merge"), same, "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row"))
    return once.unionByName(more.select("row.*"))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
