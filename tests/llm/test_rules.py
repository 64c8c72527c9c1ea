"""Quality rules against plain Python; the order of the cascade; no Python on the executors."""

import itertools
import random
from collections import Counter

import pytest

from arbora.llm import rules

DOCS = "doc_id long, text string, kept string, words string, failed string"


def slow(text):
    text = text or ""
    words = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    chars = sum(map(len, words))
    m = {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_digits": sum(c in "0123456789" for c in text), "n_capitals": sum("A" <= c <= "Z" for c in text), "longest_word": max(map(len, words), default=0),
    }
    failed = {
        "few_words": len(words) < 50, "repeated_words": 100 * len(covered) > 50 * len(words), "symbols": 100 * m["n_symbols"] > 10 * len(words), "duplicate_lines": 100 * m["n_dup_lines"] > 30 * len(lines),
        "word_length": chars < 2 * len(words) or chars > 12 * len(words), "digits": 100 * m["n_digits"] > 20 * chars, "capitals": 100 * m["n_capitals"] > 50 * chars, "longest_word": m["longest_word"] > 1000,
    }
    return m, {k for k, v in failed.items() if v}


def some_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijé", k=rng.randrange(1, 9)))
    text = lambda n: "".join(word() + rng.choice([" "] * 9 + ["\n", "\t", " \x0b", ".\n", " 😀 "]) for _ in range(n))
    texts = [text(rng.randrange(0, 120)) for _ in range(60)]
    texts += [text(80) + " ### *** $$$ %%% &&& ||| <<< >>>", "a line of words\n" * 40 + text(60), text(60).upper(), "12345678 " * 30 + text(50), text(70) + "z" * 1001, "x " * 60, "a b c " * 30, text(20) * 3 + text(200), "y" * 30 + (" " + "v" * 20) * 70]
    texts += [None, "", " \n\t ", "\n\n\n", "\x1f \x85\xa0 a", "word"]
    return [(i, t, "k", "w", "f") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (0, texts[0], "k", "w", "f")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS)


def test_all_measures_and_verdicts(docs):
    every = list(rules.MEASURES)
    got = rules.quality_rules(docs, always=every).select("row.doc_id", "row.text", "kept", "failed", *every).collect()
    assert len(got) == len(some_docs())
    reasons = Counter()
    for r in got:
        m, failed = slow(r.text)
        assert {k: r[k] for k in every} == m, r
        assert r.kept == (not failed) and (r.failed in failed or not failed)
        reasons.update(failed)
    assert set(reasons) == {r.name for r in rules.RULES}


def test_order_changes_no_verdict_and_saves_measures(docs):
    verdicts = set()
    for order in [rules.RULES, rules.RULES[::-1], rules.RULES[3:] + rules.RULES[:3]]:
        rows = rules.cascade(docs, order).collect()
        verdicts.add(tuple(sorted(str((r.row.doc_id, r.row.text, r.kept)) for r in rows)))
        own = {m: k for k, x in reversed(list(enumerate(order))) for m in x.measures}  # the first rule that needs it
        names = [x.name for x in order]
        for r in rows:
            at = names.index(r.failed) if r.failed else len(order)
            for m, k in own.items():
                assert (r[m] is None) == (k > at)
    assert len(verdicts) == 1


def test_cheap_rejecting_rules_come_first():
    a, b, c = (rules.Rule(n, (m,), "true") for n, m in (("a", "n_symbols"), ("b", "n_digits"), ("c", "n_capitals")))
    seconds = {"n_symbols": 1.0, "n_digits": 0.1, "n_capitals": 0.2}
    order = lambda rejected: [r.name for r in rules.Profile(seconds, rejected, (a, b, c)).order()]
    assert order([((True, False, False), 50), ((False, True, False), 4), ((False, False, True), 30)]) == ["c", "a", "b"]
    assert order([((True, True, False), 50), ((False, False, True), 2), ((False, False, False), 900)]) == ["b", "c", "a"]  # a adds nothing to b
    assert order([]) == ["a", "b", "c"]
    shared = rules.Profile({"words": 5.0, "word_chars": 0.1, "n_words": 0.1, "n_symbols": 1.0}, [((True, False, False), 9), ((False, True, False), 8), ((False, False, True), 7)], (rules.Rule("x", ("n_words",), ""), rules.Rule("y", ("n_symbols",), ""), rules.Rule("z", ("word_chars",), "")))
    assert [r.name for r in shared.order()] == ["y", "x", "z"]  # words are paid once


def test_profile_counts_the_sample(docs):
    p = rules.profile(docs)
    want = Counter(tuple(r.name in slow(x[1])[1] for r in rules.RULES) for x in some_docs())
    assert dict(p.rejected) == want and set(p.seconds) == set(rules.needed(rules.MEASURES)) and min(p.seconds.values()) > 0
    assert sorted(r.name for r in p.order()) == sorted(r.name for r in rules.RULES)


def test_kept_rows_and_empty_tables(spark, docs):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in some_docs() if not slow(r[1])[1])
    none = spark.createDataFrame([], DOCS)
    assert rules.quality_rules(none, always=list(rules.MEASURES)).count() == 0 and rules.keep_good(none).count() == 0


def test_no_python_in_the_plan(docs):
    plan = rules.cascade(docs, rules.RULES, rules.BASE_MEASURES)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_one_repeated_window_by_itself(spark):
    for words in itertools.product("ab", repeat=7):
        text = " ".join(words)
        assert slow(text)[0]["n_repeat_words"] in range(8)
    rows = [(i, " ".join(w), "", "", "") for i, w in enumerate(itertools.product("ab", repeat=7))]
    got = rules.measured(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), ["n_repeat_words"]).collect()
    assert all(r.n_repeat_words == slow(r.text)[0]["n_repeat_words"] for r in got)
