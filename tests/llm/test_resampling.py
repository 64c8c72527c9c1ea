"""Importance resampling against counting in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, rank long, score string, row string"


def grams(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def by_hand(rows, target):
    """(doc_id, n_features, weight, score, rank) for each row."""
    s, t = (Counter(bucket(f) for text in texts for f in grams(text)[1]) for texts in ([r[1] for r in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000) / ((s[b] + 1.0) * (t.total() + 10000)))) for b in s}
    out = []
    for r in rows:
        words, own = grams(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 5 * len(able) // 100], 1):
        x[4] = k
    return [tuple(x[:5]) for x in out]


def some_docs():
    rng = random.Random(4)
    vocab = ["alpha", "Béta", "gamma9", "Δδ", "x", "the", "of", "und"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 90))).replace(" x ", rng.choice([" - ", "\x00", "\t", "É"])), 1, "s", "r") for i in range(120)]
    return rows + [(200, None, None, None, None), (201, "", 1, "s", "r"), (None, "the of und " * 30, 1, "s", "r"), (202, "THE of uNd", 1, "s", "r"), rows[3], rows[3], (203, " ... ", 1, "s", "r")]


def as_key(rows):
    return sorted(map(str, rows))


def ranked(docs, target):
    rows = resampling.ranks(resampling.scored(docs, target).drop("row"))
    return rows.select("id", "n_features", "weight", "score", "rank")


def test_scores_and_ranks(spark):
    rows, target = some_docs(), ["the of und gamma9", "Δδ the X-the", None, ""]
    got = ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(t,) for t in target], "text string"))
    want = by_hand(rows, target)
    assert as_key(map(tuple, got.collect())) == as_key(want) and sum(r[4] is not None for r in want) == 4


def test_drawn_rows(spark):
    docs = spark.createDataFrame(some_docs(), DOCS)
    target = spark.createDataFrame([("the of und gamma9",)], "text string")
    want = Counter(r[0] for r in by_hand(some_docs(), ["the of und gamma9"]) if r[4])
    got = resampling.resample(docs, target)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    all_of_them = resampling.resample(docs, target, percent=100, min_words=0)
    assert all_of_them.count() == docs.count()


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert ranked(none, target).count() == 0 and resampling.resample(none, target).count() == 0
    rows = some_docs()
    assert as_key(map(tuple, ranked(spark.createDataFrame(rows, DOCS), target).collect())) == as_key(by_hand(rows, []))


def test_long_texts_in_slices():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "bb", "ç", "dd1", "-", ". "], k=k)) for k in (4000, 0, 3, 700, 5000, 1, 2)] + [None, "q" * 900, "word"]
    want = [Counter(map(bucket, grams(t)[1])) for t in texts]
    for size in (40, 1000, 1 << 20):
        got, words = [Counter() for _ in texts], [0] * len(texts)
        for first, part, context, seen in resampling.slices(pa.array(texts), 3, size):
            n, found, own = resampling.features(part, context)
            seen(own)
            for k, x in enumerate(n.tolist()):
                words[first + k] += x
            for owner, b in found:
                for o, x in zip(owner.tolist(), b.tolist()):
                    got[first + o][x] += 1
        assert got == want and words == [len(grams(t)[0]) for t in texts]


def test_crc_of_joined_texts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 31, 300, 5000):
        a, b = rng.bytes(11), rng.bytes(n)
        got = resampling.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("ids", [[5, 5, 5, None, None, 1, 2]])
def test_ties_go_to_the_smaller_id(spark, ids):
    rows = spark.createDataFrame([(i, 30, 7) for i in ids] * 10, "id int, n_words int, score int")
    got = resampling.ranks(rows, percent=30).where("rank is not null").orderBy("rank").collect()
    assert [r.id for r in got] == [1] * 10 + [2] * 10 + [5] and [r["rank"] for r in got] == list(range(1, 22))
    assert resampling.ranks(rows, percent=100).where(F.col("rank") > 50).where("id is not null").count() == 0
