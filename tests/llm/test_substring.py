"""Passage removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import substring

DOCS = "doc_id long, text string, _at string, n_words long"


def slow(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def some_texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)] + ["über", "a b", "X,", "x"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, edge, short = make(80), make(35), make(34)
    texts = [make(rng.randrange(0, 300)) for _ in range(15)]
    for _ in range(8):
        t = make(120)
        at = rng.randrange(120)
        texts.append(t[:at] + passage[rng.randrange(20) : rng.randrange(60, 81)] + t[at:])
    texts += [make(50) + edge, edge + make(50), make(10) + short + make(9), make(11) + short, edge]
    own = make(60)
    texts += [own + make(20) + own, ["a"] * 200, ["a", "b"] * 60, ["z"] * 35, ["y"] * 36, make(34)]
    near = list(texts[0])
    texts += [near[:100] + ["changed"] + near[101:], list(near), []]
    joined = [rng.choice([" ", "\n", "\t  "]).join(t) for t in texts]
    return [*joined, None, "", joined[3]]


@pytest.mark.parametrize(("window", "seed_words", "hot"), [(35, 8, 1000), (35, 35, 1), (12, 3, 1), (35, 8, 30)])
def test_digest(spark, monkeypatch, window, seed_words, hot):
    """``hot``: 1000 settles all of a small table without joins, 1 by joins alone, 30 by both."""
    monkeypatch.setattr(substring, "HOT", hot)
    texts = some_texts()
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_digest(spark.createDataFrame(rows, DOCS).repartition(3), window, seed_words).collect()}
    want = slow(texts, window)
    assert sum(n for _, n, _ in want) > 300
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0), (None, "a", "", 0), (None, None, "", 0)], DOCS)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_digest(docs).collect()), key=str)
    assert got == sorted([(1, 40, 40), (1, 40, 40), (None, 1, 0), (None, 0, 0)], key=str)
    assert substring.substring_digest(docs.limit(0)).count() == 0


def test_copies_of_one_row_are_one_list_of_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text)] * 40 + [(1, text + " end")], "doc_id long, text string")
    got = {len(r["at"]) for r in substring.repeated_windows(docs).collect()}
    assert max(got) < 30  # places of one text, not of its copies


def test_text_longer_than_a_block():
    from arbora.llm.words import BLOCK_BYTES

    words = [f"w{i % 7919}" for i in range(900_000)]
    text = " ".join(words)
    assert len(text) > BLOCK_BYTES and substring.Hashed(text).n == len(words)
    h = substring.Hashed(text + " " * BLOCK_BYTES)
    one, two = h.ranges(np.array([5, 7919 + 5]), np.array([5 + 700_000, 7919 + 5 + 700_000]))
    assert h.n == len(words) and one == two


def test_runs_and_cut_texts(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    want = slow(texts, 35)
    runs = {}
    for r in substring.repeats(docs).collect():
        assert r.end_word - r.first_word >= 35
        runs[r.doc_id] = runs.get(r.doc_id, 0) + r.end_word - r.first_word
    assert runs == {i: n for i, (_, n, _) in enumerate(want) if n}
    clash = docs.withColumns({c: F.lit(c) for c in ("_at", "at", "row", "key", "key2", "_key")})
    cut = substring.drop_repeats(clash)
    assert cut.columns == clash.columns
    cut = {r.doc_id: r for r in cut.collect()}
    assert all((r["_at"], r["at"], r["row"], r["key"], r["key2"]) == ("_at", "at", "row", "key", "key2") for r in cut.values())
    for i, t in enumerate(texts):
        if want[i][1] == 0:
            assert cut[i].text == t
        else:
            kept = re.findall(r"[^\x20\x09-\x0D]+", cut[i].text)
            assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == want[i][2] and cut[i].n_chars == len(cut[i].text)


def test_hash_of_a_range_depends_on_its_words_alone():
    h = substring.Hashed("q r a b c d x a b c d")
    at = h.ranges(np.array([2, 7, 1]), np.array([6, 11, 5]))
    assert at[0] == at[1] != at[2]


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        substring.repeated_windows(spark.createDataFrame([], "doc_id long, text string"), 80, 3)
