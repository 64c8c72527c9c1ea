"""Pieces, token attribution and sampled segmentations against direct computation."""

import itertools
import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from arbora.llm import packing, pieces, tokens

TEXTS = ["", None, "a", "Hello, World!  It's 42\n\n\tnice day", "Été été ΣΣ naïve", "x " * 9000, "<|endoftext|> y", "\x0b\x0c \x00\x01 z\x85q", "long" * 700, "漢字仮名 \U0001f600"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", 0), (None, "n", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long").repartition(3).cache()


def test_pieces_hold_every_id_once(docs):
    tok = Tokenizer.from_file(packing.word_bpe_path())
    rows = packing.pack(docs, keep_ids=True).collect()
    by_doc = {}
    for r in rows:
        assert r.length == 1 << r.bucket and r.length <= 4096 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(TEXTS):
        own = sorted(by_doc[i], key=lambda r: r.start)[:: 2 if i == 3 else 1]
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and {r.doc_tokens for r in own} == {len(ids)}
    assert len(by_doc[None]) >= 1 and packing.pack(docs.limit(0)).count() == 0


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_BYTES", 3 * packing.WORD_BYTES)
    tok, ref = packing.WordTokenizer(packing.word_bpe_path()), Tokenizer.from_file(packing.word_bpe_path())
    for text in ("a b c d", "d e f", "a b"):
        assert np.frombuffer(next(tok.encode([text.encode()])), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (4096, [4096]), (4097, [4096, 1]), (9000, [4096, 4096, 512, 256, 32, 8]), (6, [4, 2])])
def test_powers_of_two(n, want):
    assert packing.powers_of_two(n, 4096) == want


def slow_allocation(sizes, ends, rule):
    begins, count, cross, at = [0, *ends[:-1]], [0.0] * len(ends), [0] * len(ends), 0
    for size in sizes:
        part = [max(0, min(e, at + size) - max(b, at)) for b, e in zip(begins, ends)]
        met = [k for k, p in enumerate(part) if p]
        for k in met if len(met) > 1 else []:
            cross[k] += 1
        if rule == "share":
            for k in met:
                count[k] += part[k] / size
        else:
            count[met[0] if rule == "first" else part.index(max(part))] += 1
        at += size
    return count, cross


@pytest.mark.parametrize("rule", tokens.RULES)
def test_allocation(rule):
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 6, rng.integers(1, 15))
        total = int(sizes.sum())
        ends = np.sort(rng.integers(0, total + 1, rng.integers(0, 6))).tolist() + [total]
        count, cross = tokens.allocate(np.array(ends), sizes, rule)
        want = slow_allocation(sizes.tolist(), ends, rule)
        assert np.allclose(count, want[0]) and cross.tolist() == want[1]


def test_sections(docs):
    rows = tokens.section_token_counts(docs).collect()
    encode, _ = tokens.encoder(tokens.byte_bpe_path())
    for i, t in enumerate(TEXTS):
        own = sorted({tuple(r) for r in rows if r.doc_id == i}, key=lambda r: r[1])
        t = t or ""
        assert "".join(t[r[2] : r[3]] for r in own) == t and [r[1] for r in own] == list(range(len(own)))
        assert sum(r[4] for r in own) == len(encode(t)) == own[0][6]
        assert all("\n" not in t[r[2] : r[3] - 1] for r in own)
    assert tokens.section_token_counts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.section_token_counts(docs, "none")


@pytest.mark.parametrize("rule", tokens.RULES)
def test_lines_by_brute_force(spark, monkeypatch, rule):
    """Each line's tokens and crossings from the offsets of single decoded tokens, in batches of a few lines."""
    monkeypatch.setattr(tokens, "BATCH_LINES", 5)
    texts = ["one line", "a\n\n\nb  \n  c\n", "x\n" * 40 + "  \n\t\n end", "naïve\n漢字\n\U0001f600\n\n", "  \n  \n", "\n" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.section): (round(r.n_tokens, 9), r.n_crossing) for r in tokens.section_token_counts(docs, rule).collect()}
    encode, sizes = tokens.encoder(tokens.byte_bpe_path())
    want = {}
    for i, t in enumerate(texts):
        lines = t.encode().split(b"\n")
        ends = list(itertools.accumulate(len(x) + 1 for x in lines))
        ends = ends[:-1] if not lines[-1] else [*ends[:-1], len(t.encode())]
        count, cross = slow_allocation([int(sizes[x]) for x in encode(t)], ends, rule)
        want.update({(i, k): (round(c, 9), x) for k, (c, x) in enumerate(zip(count, cross))})
    assert got == want and any(x for _, x in want.values())


def test_fields(spark):
    rows = spark.createDataFrame([("ab cd", "ef", None), (None, None, None), ("x", "", "yz")], "a string, b string, field_tokens string")
    got = [r.field_tokens for r in tokens.field_token_counts(rows, ["a", "b", "field_tokens"], rule="first").collect()]
    encode, _ = tokens.encoder(tokens.byte_bpe_path())
    assert [sum(g) for g in got] == [len(encode(t)) for t in ("ab cd\nef\n", "\n\n", "x\n\nyz")]


@pytest.fixture(scope="module")
def vocab():
    return pieces.pieces_of(pieces.piece_bpe_path())


def test_segmentations_decode_and_differ(docs, vocab):
    rows = pieces.sample_segmentations(docs, k=4, keep_ids=True).collect()
    by_doc = {}
    for r in rows:
        assert r.decodes and vocab.decode(r.ids) == (TEXTS[r.doc_id] if r.doc_id is not None else "n") or r.doc_id in (0, 1) and not r.ids
        by_doc.setdefault(r.doc_id, []).append(r)
    for i in range(2, len(TEXTS)):
        own = sorted(by_doc[i], key=lambda r: r.sample)
        distinct = {tuple(r.ids) for r in own}
        assert len(distinct) == (len(own) if i != 3 else len(own) / 2)
        assert all(a.perturbed >= b.perturbed and 0 < b.inclusion <= 1 or b.inclusion == 0 for a, b in zip(own, own[1:]))
    assert len(by_doc[0]) == len(by_doc[1]) == 1
    assert pieces.sample_segmentations(docs.limit(0)).count() == 0


def test_each_sample_is_decoded(monkeypatch):
    import pyarrow as pa

    real = pieces.sample

    def wrong(vocab, texts, seeds, k):
        for first, (ids, *rest), *more in real(vocab, texts, seeds, k):
            yield [first, (np.append(ids[:-1], ids[-1] + 1), *rest), *more]

    monkeypatch.setattr(pieces, "sample", wrong)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the quick brown fox", "jumps over it"])], ["doc_id", "text"])
    got = pa.Table.from_batches(pieces._runner(pieces.piece_bpe_path(), 3, 0, False)([batch]))
    assert got.column("decodes").to_pylist() == [True, False, True] * 2


def test_samples_do_not_depend_on_neighbours(vocab):
    texts, seeds = ["the quick brown fox", "jumps over", "the lazy dog\n"], [11, 22, 33]
    together = list(pieces.sample(vocab, texts, seeds, 3))
    for t, s, want in zip(texts, seeds, together):
        (got,) = pieces.sample(vocab, [t], [s], 3)
        assert [(g[0].tolist(), round(g[1], 9)) for g in got] == [(w[0].tolist(), round(w[1], 9)) for w in want]


def all_segmentations(vocab, chunk):
    names = vocab.names

    def go(at):
        if at == len(chunk):
            yield (), 0.0
        for end in range(at + 1, len(chunk) + 1):
            if (i := names.get(chunk[at:end])) is not None:
                for rest, log in go(end):
                    yield (i, *rest), log + vocab.logs[i]

    found = dict(go(0))
    top = np.logaddexp.reduce(list(found.values()))
    return {k: v - top for k, v in found.items()}


def test_without_replacement_as_by_listing(vocab):
    """Sampling all paths lists every segmentation with its probability; first samples come as often as they should, and so
    do ordered pairs of samples."""
    text = "to be"
    one, two = (all_segmentations(vocab, c) for c in vocab.chunks(text))
    exact = {a + b: x + y for a, x in one.items() for b, y in two.items()}
    (every,) = pieces.sample(vocab, [text], [1], len(exact) + 5)
    assert {tuple(ids.tolist()): round(log, 8) for ids, log, *_ in every} == {k: round(v, 8) for k, v in exact.items()}
    assert all(inclusion == 1 for *_, inclusion in every)
    n = 4000
    got = list(pieces.sample(vocab, [text] * n, list(range(n)), 2))
    likely = max(exact, key=exact.get)
    p = math.exp(exact[likely])
    share = np.mean([tuple(g[0][0].tolist()) == likely for g in got])
    assert abs(share - p) < 4 * math.sqrt(p * (1 - p) / n)
    second = sorted(exact, key=exact.get)[-2]
    q = p * math.exp(exact[second]) / (1 - p)
    share = np.mean([tuple(g[0][0].tolist()) == likely and tuple(g[1][0].tolist()) == second for g in got])
    assert abs(share - q) < 4 * math.sqrt(q * (1 - q) / n)
    tops = np.array([g[0][2] for g in got])
    assert abs(tops.mean() - 0.5772) < 0.08  # standard Gumbel


@pytest.mark.parametrize(("text", "k"), [("to be", 3), ("aa b", 5), ("été", 2), ("x", 4)])
def test_every_segmentation_comes_as_often_as_it_should(vocab, text, k):
    """Whether a path is among k drawn without replacement, against all ordered draws; and inverse inclusion scores, which make
    the sampled probabilities add up to one on average."""
    exact = {(): 0.0}
    for c in vocab.chunks(text):
        exact = {a + b: x + y for a, x in exact.items() for b, y in all_segmentations(vocab, c).items()}
    p = {a: math.exp(x) for a, x in exact.items()}
    want = dict.fromkeys(p, 0.0)

    def draw(chosen, chance):
        left = math.fsum(p[a] for a in p if a not in chosen)
        for a in p:
            if a not in chosen:
                own = chance * p[a] / left
                want[a] += own
                if len(chosen) + 1 < min(k, len(p)):
                    draw((*chosen, a), own)

    draw((), 1.0)
    n = 3000
    got = list(pieces.sample(vocab, [text] * n, list(range(n)), k))
    seen = dict.fromkeys(p, 0)
    for row in got:
        assert len({tuple(g[0].tolist()) for g in row}) == len(row) == min(k, len(p))
        for g in row:
            seen[tuple(g[0].tolist())] += 1
    assert all(abs(seen[a] / n - want[a]) < 4.5 * math.sqrt(max(want[a] * (1 - want[a]), 1e-4) / n) + 1e-3 for a in p)
    total = np.array([math.fsum(math.exp(log) / inclusion for _, log, _, inclusion in row) for row in got])
    assert abs(total.mean() - 1) < 5 * total.std() / math.sqrt(n) + 1e-9


def test_slices_and_kept_lattices_change_nothing(vocab, monkeypatch):
    """Few chunks walked at once, lattices thrown away after every batch, and words too long for linear masses."""
    texts = ["the quick brown fox jumps over the lazy dog " * 9, "", "x", "ab" * 400 + " tail", "漢字 " * 30 + "\U0001f600" * 40]
    seeds = [5, 6, 7, 8, 9]
    plain = lambda rows: [[(g[0].tolist(), round(g[1], 7), round(g[2], 7), round(g[3], 7)) for g in row] for row in rows]
    want = plain(pieces.sample(vocab, texts, seeds, 4))
    monkeypatch.setattr(pieces, "WALKS", 3)
    monkeypatch.setattr(pieces, "CACHED_CHARS", 0)
    assert plain(pieces.sample(vocab, texts, seeds, 4)) == want
    assert plain(pieces.sample(vocab, texts[3:], seeds[3:], 4)) == want[3:]
    assert all(vocab.decode(g[0]) == t for t, row in zip(texts, want) for g in row)


def test_decode_column(spark, vocab):
    (got,) = pieces.sample(vocab, ["some text é"], [1], 1)
    df = spark.createDataFrame([(got[0][0].tolist(),), (None,), ([],)], "ids array<int>")
    assert [r.t for r in df.select(pieces.decode_column("ids").alias("t")).collect()] == ["some text é", None, ""]


def test_fast_words_equal_the_tokenizer(spark):
    """Every distinct word of a table, and odd ones, give the tokenizer's own ids."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    words = sorted({w for r in rows for w in r.text.split()} | {"it's", "IT'LL9x", "ÀÉß", "á", "×x", "<|startoftext|>", "<|x", "x\x01y", "'S'", "don't!!", "a" * 3000, "µª"})
    ref = Tokenizer.from_file(packing.word_bpe_path())
    got = packing.WordTokenizer(packing.word_bpe_path()).encode([w.encode() for w in words])
    for w, ids, e in zip(words, got, ref.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, w
