"""Periodic runs against all periods at all places."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from arbora.llm import periods

DOCS = "doc_id long, text string, start string, d string, row string"


def slow_runs(x):
    found = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(a <= i and j + q <= b for a, b, _ in found):
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for a, b, q in found), key=lambda r: (r[0], r[2]))


def sequence(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(110))]
    for _ in range(rng.randrange(4)):
        a = rng.randrange(len(x) + 1)
        p = 1 + rng.randrange(max(1, (len(x) - a) // 4))
        for i in range(a + p, min(len(x), a + p * rng.randrange(2, 9))):
            x[i] = x[i - p]
    return x


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(250):
        x = sequence(rng)
        want = slow_runs(x)
        assert periods.runs(np.array(x, np.int32)) == want
        assert [(a, b - a, q) for a, b, q in (periods.grammar_runs(np.array(x, np.int32)) if x else [])] == want  # nothing is cut before


def test_tests_in_several_rounds(monkeypatch):
    monkeypatch.setattr(periods, "TESTS", 7)
    rng = random.Random(9)
    for _ in range(100):
        x = sequence(rng)
        assert periods.runs(np.array(x, np.int32)) == slow_runs(x)


def test_wrong_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(periods._Equal, "shifted", lambda self, start, length, by: np.ones(len(start), bool))
    rng = random.Random(3)
    for _ in range(100):
        x = sequence(rng)
        assert periods.runs(np.array(x, np.int32)) == slow_runs(x)


def derived(symbol, rules):
    return [symbol] if symbol not in rules else [y for part in rules[symbol] for y in derived(part, rules)]


def test_grammar():
    rng = random.Random(8)
    for _ in range(200):
        x = sequence(rng)
        top, rules = periods.repair(x)
        assert [y for s in top for y in derived(s, rules)] == x
        left = Counter(p for p in zip(top, top[1:]) if p[0] != p[1])
        assert max(left.values(), default=0) < 2
    assert periods.repair([1, 2, 3, 1, 2, 4, 1, 2])[1] == {5: (1, 2)}
    top, rules = periods.repair(list(range(1000)) * 6)
    assert len(top) <= 6 and len(rules) < 1010


def test_long_sequences():
    assert periods.runs(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]
    assert periods.runs(np.tile(np.arange(3000), 5)[:14_000]) == [(0, 14_000, 3000)]
    assert periods.runs(np.tile(np.arange(3000), 4)[:11_999]) == []
    nested = np.tile(np.concatenate([np.zeros(7), [1, 2] * 4, [3]]), 50).astype(int)
    got = periods.runs(nested)
    assert Counter(q for *_, q in got) == {1: 50, 2: 50, 16: 1} and got == sorted(got, key=lambda r: (r[0], r[2]))


def slow_digest(doc_id, text, plant):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def some_docs():
    rng = random.Random(6)
    words = lambda: " ".join(str(w) for w in sequence(rng))
    rows = [(i, rng.choice([" ", "\n", "\t  "]).join(words().split(" ")) if i % 7 else " ".join(rng.choices("abcdefgh", k=140)), "s", "d", "r") for i in range(150)]
    return rows + [(300, None, None, None, None), (301, "", "s", "d", "r"), (None, "a b " * 9, "s", "d", "r"), rows[5], (302, "é é é é é é z", "s", "d", "r"), (303, "a a a a a", "s", "d", "r")]


@pytest.mark.parametrize("plant", [True, False])
def test_digest(spark, plant):
    rows = some_docs()
    got = periods.run_digest(spark.createDataFrame(rows, DOCS), plant).collect()
    want = [slow_digest(r[0], r[1], plant) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 20
    assert periods.run_digest(spark.createDataFrame([], DOCS), plant).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame(some_docs(), DOCS)
    want = sorted(str((r[0], *x)) for r in some_docs() for x in slow_runs((r[1] or "").split()))
    assert sorted(str(tuple(r)) for r in periods.periodic_runs(docs).collect()) == want
    cut = periods.collapse_runs(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got[300] is None and got[301] == "" and got[302] == "é z" and got[303] == "a a a a a" and got[None] == "a b"
