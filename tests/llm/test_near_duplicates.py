"""SimHash groups, vector groups and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbora.llm import graph, pq, simhash

DOCS = "doc_id long, text string, fp long, component_id string"


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def some_docs():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(300)] = rng.choice(vocab)
            texts.append(" ".join(near))
    texts += ["", None, "one", "ONE two", "one two THREE", "Été Été x", "a b c\td\x0be", texts[0], texts[0].upper()]
    return [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x")]


@pytest.mark.parametrize("text", [None, "", " \t", "a", "A b", "a b c", "a b c d e", "Grüße a b \x1f c", "x " * 5000, "퟿ w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"v{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_lists", lambda data: (p.split() for p in __import__("arbora.llm.words", fromlist=["blocks"]).blocks(data, 50)))
    assert simhash.fingerprint(text) == whole == (slow_fingerprint(text) ^ 1 << 63) - (1 << 63)


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_every_block_size(monkeypatch, width):
    from arbora.llm.words import blocks

    texts = ["a b c d e f g", "one two", "", "  ", "abc def ghi   " + " " * 30, " " * 30 + "x y z w", "a" * 25 + " b c", "k l m n o p" + " " * 9 + "q"]
    for text in texts:
        words = text.split()
        shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
        want = sorted(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles)
        for size in range(1, 45):
            monkeypatch.setattr(simhash, "word_lists", lambda data, size=size: (p.split() for p in blocks(data, size)))
            assert sorted(h for part in simhash._shingle_hashes(text, width) for h in part.tolist()) == want


def test_texts_longer_than_a_block():
    from arbora.llm.words import BLOCK_BYTES

    some = " ".join(f"w{i}" for i in range(40))
    for text in (some + " " * BLOCK_BYTES, " " * BLOCK_BYTES + some, some + " " * (BLOCK_BYTES - len(some) - 2) + "last", some + " " * (BLOCK_BYTES - len(some) - 4) + "last", " ".join([some] * (BLOCK_BYTES // len(some) + 1))):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_groups(spark):
    rows = some_docs()
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = closure(fps, links)
    assert len(links) > 20 and len(got) == len(rows)
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got} == {(i, fps[i], want[i]) for i in fps}


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written."""
    seen = []

    def stash(df, name, release=True, write=simhash.stash):
        seen.append(plan(df))
        return write(df, name, release)

    for module in (simhash, graph):
        monkeypatch.setattr(module, "stash", stash)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_that_grows_is_broadcast(spark, plans, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    rows = some_docs()
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    groups = simhash.simhash_groups(docs)
    plans.append(plan(groups))
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows}
    want = closure(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in groups.collect()} == want


def test_no_text_or_kept_id_is_broadcast(spark, plans, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    docs = spark.createDataFrame(some_docs(), DOCS)
    kept = simhash.drop_near_duplicates(docs)
    plans.append(plan(kept))
    assert "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)


def test_kept_documents(spark):
    docs = spark.createDataFrame(some_docs(), DOCS)
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(groups.values()))


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d", 0, ""), (5, "a b c d", 0, ""), (None, None, 0, "")], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None)], key=str)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, "a b c d"), (None, None)], key=str)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat, share an id with other texts, or have none."""
    long = " ".join(f"q{i}" for i in range(80))
    rows = [(1, "a b c d")] * 3 + [(1, "x y z w"), (1, long), (2, long + " end"), (None, "m n o p"), (None, "m n o p"), (7, "M n o p"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "hash", "row", "fp", "node", "best")})
    kept = simhash.drop_near_duplicates(docs)
    fps = {(i, t): slow_fingerprint(t) for i, t in rows}
    root = closure(set(fps.values()), [(a, b) for a in set(fps.values()) for b in set(fps.values()) if a < b and (a ^ b).bit_count() <= 3])
    got = kept.select("doc_id", "text").collect()
    assert kept.columns == docs.columns and sorted(root[fps[r.doc_id, r.text]] for r in got) == sorted(set(root.values()))
    first = {c: min((i is None, i or 0) for (i, t), f in fps.items() if root[f] == c) for c in root.values()}
    assert all((r.doc_id is None, r.doc_id or 0) == first[root[fps[r.doc_id, r.text]]] for r in got)


def test_links_cover_every_pattern_of_three_bits(spark):
    base = 0x0123456789ABCDEF
    rng = random.Random(2)
    flips = [rng.sample(range(64), rng.randrange(1, 4)) for _ in range(300)] + [[0], [63], [15, 16], [47, 48, 63], [0, 1, 2]]
    rows = [(i + 1, base ^ sum(1 << b for b in f)) for i, f in enumerate(flips)]
    rows = [(0, base)] + [(i, v) for v, i in {v: i for i, v in rows}.items()]
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in rows]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "id long, fp long")).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = closure({x for p in links for x in p}, links)
    del want[300]
    assert got == want


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(15):
        center = rng.normal(size=16)
        rows += [center + rng.normal(size=16) * rng.choice([0.03, 0.1, 0.2]) for _ in range(12)]
    rows += [rows[0]] * 5 + [rows[0] * 3.0, rows[1] * 1e-30]
    out = [(i, [float(np.float32(y)) for y in x], 9) for i, x in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 9), (n + 1, [0.0] * 16, 9), (n + 2, [float("nan")] + [1.0] * 15, 9), (n + 3, [None] + [1.0] * 15, 9), (n + 4, [float("inf")] * 16, 9), (n + 5, [1.0, 2.0], 9), (n + 6, [], 9)]


@pytest.mark.parametrize(("block", "list_rows", "coarse", "codes"), [(7, 512, 1024, 64), (4096, 16, 1024, 64), (50, 4, 3, 4)])
def test_vector_groups(spark, monkeypatch, block, list_rows, coarse, codes):
    """One list in small blocks, several lists, and lists split by residual codes."""
    for name, value in (("BLOCK_ROWS", block), ("LIST_ROWS", list_rows), ("COARSE_LISTS", coarse), ("CODES", codes)):
        monkeypatch.setattr(pq, name, value)
    rows = vectors()
    ok = {i: np.array(x) for i, x, _ in rows[:-7]}
    cos = lambda a, b: float(a / np.linalg.norm(a) @ (b / np.linalg.norm(b)))
    links = [(a, b) for a in ok for b in ok if a < b and cos(ok[a], ok[b]) >= 0.95]
    comp = closure([i for i, *_ in rows], links)
    degree = {i: sum(i in p for p in links) for i, *_ in rows}
    got = pq.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, degree[i], comp[i], i == comp[i]) for i, *_ in rows}
    assert len(links) > 100 and len(got) == len(rows)


def test_recall_on_planted_links(spark):
    """64 dimensions, links right above the threshold, lists of about 100 rows: recall against brute force, and no false link."""
    rng = np.random.default_rng(5)
    base = pq.unit(rng.normal(size=(4000, 64)))
    step = rng.normal(size=(1000, 64))
    step -= (step * base[:1000]).sum(1, keepdims=True) * base[:1000]
    cos = rng.uniform(0.951, 0.97, (1000, 1))
    x = np.concatenate([base, cos * base[:1000] + np.sqrt(1 - cos**2) * pq.unit(step)]).astype(np.float32)
    u = pq.unit(x.astype(float))
    degree = ((u @ u.T) >= 0.95).sum(1) - 1
    pq_rows, pq.LIST_ROWS = pq.LIST_ROWS, 100
    try:
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        got = {r.vec_id: r.n_links for r in pq.vector_groups(rows).collect()}
    finally:
        pq.LIST_ROWS = pq_rows
    assert degree.sum() >= 2000 and all(got[i] <= degree[i] for i in got)
    assert sum(got.values()) >= 0.99 * degree.sum()


def test_most_lists_are_not_probed():
    rng = np.random.default_rng(6)
    x = pq.unit(rng.normal(size=(6000, 64)))
    coarse, levels = pq.layout(len(x), 100, 1024, 64, 8)
    lists = pq.Lists(pq.fit(x, coarse), levels, np.sqrt(2 - 2 * pq.COSINE) * pq.SLACK / 8)
    assert (coarse, levels) == (60, 0) and len(lists.place(x)[1]) < 0.25 * coarse * len(x)


@pytest.mark.parametrize(("n", "want"), [(0, (1, 0)), (600, (1, 0)), (51_200, (100, 0)), (10**6, (31, 1)), (10**9, (477, 2))])
def test_lists_grow_with_the_vectors(n, want):
    assert pq.layout(n, 512, 1024, 64, 8) == want


def test_rows_that_share_an_id_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.1])]
    got = pq.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4)]


def test_vector_groups_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in pq.vector_groups(rows).collect()} == {(1, 0, 1), (None, 0, None)}
    assert pq.vector_groups(rows.limit(0)).count() == 0


def test_asymmetric_distances_are_within_the_coding_error():
    rng = np.random.default_rng(0)
    x = pq.unit(rng.normal(size=(500, 20)))
    model = pq.fit(x, 8)
    q, rows = x[:40] - model.centers[0], x[40:] - model.centers[0]
    codes, error = model.encode(rows)
    true = np.linalg.norm(q[:, None] - rows[None], axis=2)
    assert (np.abs(model.distances(q, codes) - true) <= error + 1e-6).all()


@pytest.mark.parametrize(("n", "most", "least"), [(51_200, 8, 0.99), (1_000_000, 22, 0.985), (100_000_000, 95, 0.98)])
def test_probes_and_recall_of_planted_links_at_any_size(n, most, least):
    """Lists of all vectors of so large a table, on isotropic vectors, the hardest ones; links at the very threshold."""
    rng = np.random.default_rng(0)
    coarse, levels = pq.layout(n, pq.LIST_ROWS, pq.COARSE_LISTS, pq.CODES, pq.SUBSPACES)
    model = pq.fit(pq.unit(rng.normal(size=(max(64 * coarse, 4096), 64))), coarse)
    x = pq.unit(rng.normal(size=(1000, 64)))
    y = rng.normal(size=x.shape)
    y = pq.unit(y - (x * y).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.95, 0.955, (1000, 1))
    lists = pq.Lists(model, levels, 0.1**0.5 * pq.SLACK / 8)
    homes, probed = [], []
    for z in (x, cos * x + np.sqrt(1 - cos**2) * y):
        home, row, probe = lists.place(z)
        homes.append(home)
        probed.append(set(zip(row.tolist(), probe.tolist())))
        assert len(probe) / len(z) < most and all((i, h) in probed[-1] for i, h in enumerate(home.tolist()))
    found = [(i, homes[1][i]) in probed[0] or (i, homes[0][i]) in probed[1] for i in range(len(x))]
    assert np.mean(found) >= least
