"""Held-out accuracy of the classifiers, licence scans and exact search against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from arbora.llm import langid, licenses, quality, topk

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_scores_by_hand(tables):
    """Features from plain compressed sizes, scores from the fitted weights."""
    docs, labels = tables
    model = quality.train(docs, labels)
    size = lambda data, d: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
    some = docs.where("doc_id % 23 = 0").collect()
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(some) > 30
    for r in some:
        data = (r.text or "").encode()
        g, b = size(data, model.good), size(data, model.bad)
        z = model.weights[2] + (model.weights[0] * (b - g) / len(data) + model.weights[1] * math.log((g + b) / 2 / len(data)) if data else 0)
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


def test_logistic_fit_is_stationary():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2)) * [3, 0.1] + [1, 5]
    y = (x @ [1.0, 8.0] - 41 + rng.logistic(size=500) > 0).astype(float)
    w = quality.logistic_fit(x, y, ridge=0.0)
    p = 1 / (1 + np.exp(-(x @ np.array(w[:2]) + w[2])))
    assert np.abs(x.T @ (y - p)).max() < 1e-6 and abs((y - p).sum()) < 1e-6


def test_repeated_and_contradicting_labels(spark):
    rows = [(1, 0), (1, 0), (2, 1), (3, 0), (3, 1), (4, None), (5, 7), (None, 1), (6, 1), (6, None)]
    got = quality.usable_labels(spark.createDataFrame(rows, "doc_id long, quality int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0), (2, 1), (6, 1)]


def test_quality_learns_nothing_from_the_held_out_fold(tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, other)


def test_quality_of_odd_rows(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (2, ""), (3, "long " * 40000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = odd.select("doc_id", quality.score_column("text", model).alias("s")).collect()
    assert len(got) == 5 and all(0 <= r.s <= 1 for r in got) and got[1].s == got[2].s
    none = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.held_out for r in none if r.doc_id is None} == {False}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_language_on_the_held_out_fold(tables):
    docs, _ = tables
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.accepted.mean() > 0.99


def test_language_scores_by_hand(tables):
    """Subwords, votes, softmax and temperature by plain loops from the fitted model."""
    docs, _ = tables
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    some = docs.where("doc_id % 97 = 0").collect()
    assert len(some) > 8
    for r in some:
        text = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in r.text.encode())
        data = (" " + " ".join(text.split(" ")) + " ").encode("latin-1")
        data = b" " + b" ".join(w for w in data.split(b" ") if w) + b" "
        total, n = np.zeros(len(model.languages)), 0
        for k, width in enumerate((2, 3, 4)):
            for i in range(len(data) - width + 1):
                gram = int.from_bytes(data[i : i + width], "little")
                total += model.votes[((gram ^ (k * 0x27D4EB2F) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 16]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        own = got[r.doc_id]
        assert own.lang_pred == model.languages[int(p.argmax())] and abs(own.score - p.max()) < 1e-6 and own.accepted == (p.max() >= model.threshold)


def test_every_language_is_learned(spark):
    """600 languages, each with words of its own; the rare ones too."""
    rng = random.Random(4)
    word = lambda k: "".join(chr(0x4E00 + k * 4 + rng.randrange(4)) for _ in range(3))
    rows = [(k * 60 + i, " ".join(word(k) for _ in range(12)), f"l{k}") for k in range(600) for i in range(60 if k % 2 else 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 600
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert set(got.lang_pred) > {f"l{k}" for k in range(0, 600, 2)} and (got.lang == got.lang_pred).mean() > 0.9


def test_language_learns_nothing_from_the_held_out_fold(tables):
    docs, _ = tables
    other = docs.withColumn("lang", F.when(langid.fold() == 2, "xx").otherwise(F.col("lang")))
    a, b = langid.train(docs, 400, 200), langid.train(other, 400, 200)
    assert a.languages == b.languages and np.array_equal(a.votes, b.votes) and a.threshold == b.threshold


def test_language_of_odd_rows(spark, tables):
    docs, _ = tables
    odd = spark.createDataFrame([(None, "le la les une dans pour", "fr"), (1, None, "fr"), (2, "", None), (3, "12 34 !! ²½Ⅷ_", "de"), (4, "le", None), (4, "le", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    model = langid.train(docs, 400, 200)
    got = odd.select("doc_id", langid.predict_column("text", model).alias("p")).collect()
    assert [r.p.lang_pred for r in got][1:4] == ["und"] * 3 and [r.p.score for r in got][1:4] == [0.0] * 3 and got[4].p == got[5].p
    assert not any(r.p.accepted for r in got[1:4]) and got[0].p.lang_pred == "fr"
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0 and langid.keep_identified(docs).columns == docs.columns


def test_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    z = rng.normal(size=(4000, 3))
    z[np.arange(4000), y] += 2
    t, threshold = langid.calibrate(z * 5, y)
    assert 2.2 < t < 2.8 and 0 < threshold <= 0.5  # unit noise, shifted by 2: the log odds are twice z


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "CC-BY cc by", "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0. All  rights\nreserved", "GNU General Public License general-public license",
    "Released under the terms of the MIT License; released under MIT license", "Copyright (c) 2020 Someone Else. All rights reserved.", "copyright all rights reserved", "copyright " + "x " * 9 + "all rights reserved",
    "SPDX-License-Identifier: Zero", "spdx license identifier", "é cc by É", "xcc by", "cc byé", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "associated permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Code\"), to deal in the Code without restriction",
]
ACCEPTED = {3: {"cc-by-nc-4.0"}, 4: {"apache-2.0"}, 6: {"mit"}, 7: {"copyright-notice"}, 10: {"spdx-tag"}, 15: {"gpl-3.0"}, 16: {"mit-text"}}


def test_scan(spark):
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "cc by", "c")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in licenses.license_spans(rows).collect()}
    for i, t in enumerate(TEXTS):
        words = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        want = {(label, k) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()}
        assert got[i].n_words == len(words)
        assert {(s.label, s.first_word) for s in got[i].spans if s.base} == want
        assert {s.label for s in got[i].spans if not s.base} == ACCEPTED.get(i, set()), t
    assert got[None].n_words == 2 and licenses.license_spans(rows.limit(0)).count() == 0


def test_automaton():
    a = licenses.Automaton("a [b c] <x|y z> {1,2} end")
    runs = lambda t: a.longest(iter(t.encode().split()))
    assert runs("a x q end") == 4 and runs("a b c y z q r end more") == 8
    assert not any(map(runs, ("a x end", "a b x q end", "a y q end", "b", "a x p q r end")))
    for bad in ("[a]", "{1,2} a", "a [b", "a ]"):
        with pytest.raises((ValueError, IndexError)):
            licenses.Automaton(bad)


def slow_top(rows, k=5):
    ok = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (q, y) in enumerate(ok):
        if q % 50 == 0:
            scores = sorted((-sum(int(u) * int(v) for u, v in zip(y, x)), i) for b, (i, x) in enumerate(ok) if b != a and len(x) == len(y))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 4096, 8192), (4, 60, 100), (3, 20, 7)])
def test_top_k(spark, monkeypatch, sizes):
    """Rows of the same id are queries and candidates of their own."""
    for name, value in zip(("QUERY_ROWS", "BLOCK_ROWS", "SHARD_ROWS"), sizes):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in np.floor(rng.normal(size=6) * rng.choice([3, 300]))]) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(40)] + [(5000, None), (5050, [float("nan")] * 6), (5100, [None] + [1.0] * 5), (None, [1.0] * 6), (50, [-400.0] * 6), (50, rows[3][1]), (100, [7.0] * 3), (9, [2.0] * 3)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == slow_top(rows)


def test_cells_out_of_reach_are_not_met():
    """Clustered vectors: most cells, and most pairs in the rest, are pruned; no result is lost."""
    rng = np.random.default_rng(9)
    centers = np.floor(rng.normal(size=(30, 32)) * 4000)
    x = np.floor(centers.repeat(200, 0) + rng.normal(size=(6000, 32)) * 100)
    cell, d = topk.nearest(x, centers)
    angle = np.arccos(np.clip((x * centers[cell]).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(centers[cell], axis=1), -1, 1))
    scores = x[::25] @ x.T
    scores[np.arange(240), np.arange(0, 6000, 25)] = -np.inf
    floor = np.sort(scores, axis=1)[:, -5]
    of = lambda rows, c, **more: dict(cell=c, far=float(np.sqrt(d[rows, c].max())), angle=float(angle[rows].max()), length=float(np.linalg.norm(x[rows], axis=1).max()), **more)
    cand = [of(np.flatnonzero(cell == c), c) for c in range(30)]
    asked = [of(25 * np.flatnonzero(cell[::25] == c), c, floor=float(floor[cell[::25] == c].min())) for c in np.unique(cell[::25])]
    alive = topk.surviving_cells(asked, cand, centers)
    best = np.argsort(-scores, axis=1)[:, :5]
    at = {r["cell"]: i for i, r in enumerate(asked)}
    assert alive.mean() < 0.2 and all(alive[at[cell[25 * q]], cell[best[q]]].all() for q in range(240))
    search = topk.Search(np.arange(0, 6000, 25), np.arange(0, 6000, 25), np.full(240, topk._NONE), x[::25], 5)
    for start in range(0, 6000, 1000):
        search.scan(np.arange(start, start + 1000), np.arange(start, start + 1000), x[start : start + 1000])
    assert search.met < 0.5 * 240 * 6000
    got = search.results().to_pandas().groupby("query_id").score.min()
    assert (got.to_numpy() == floor).all()


def test_top_k_of_little(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 4.0])], "vec_id long, vec array<double>")
    assert [tuple(r) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, 11)]
    assert topk.top_k(rows, F.lit(False)).count() == 0 and topk.top_k(rows.limit(0), F.lit(True)).count() == 0


def test_cover_tree_covers():
    x = np.floor(np.random.default_rng(7).normal(size=(3000, 5)) * 50)
    root, order = topk.cover_tree(np.concatenate([x, x[:500]]), 20)
    assert sorted(order.tolist()) == list(range(3500))
    rows = np.concatenate([x, x[:500]])[order]
    todo = [root]
    while todo:
        node = todo.pop()
        assert (np.sqrt(((rows[node.low : node.high] - node.center) ** 2).sum(1)) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted((c.low, c.high) for c in node.children)[0][0] == node.low and sum(c.high - c.low for c in node.children) == node.high - node.low
            todo += node.children


def test_large_numbers_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-(2**30), 2**30)) for _ in range(4)]) for i in range(120)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == slow_top(rows)
