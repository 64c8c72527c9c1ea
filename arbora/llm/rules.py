"""Quality rules as a short-circuit cascade of column expressions: the order comes from a sample, the verdict does not.

Only DataFrame functions are used: no Python runs on the executors.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.plans import stash

#: About so many rows are sampled to estimate what a rule costs and rejects.
SAMPLE_ROWS = 2000
#: Whole numbers a hundredth of which a rule compares with a share.
MIN_WORDS, REPEATED_PERCENT = 50, 50
SYMBOL_PERCENT, DUPLICATE_LINE_PERCENT, DIGIT_PERCENT, CAPITAL_PERCENT = 10, 30, 20, 50
SHORT_WORDS, LONG_WORDS, LONGEST_WORD = 2, 12, 1000

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_WINDOW = 3


def _count(chars: str) -> Column:
    """How many characters of the text are in a class."""
    return F.length(F.regexp_replace(_text(), f"[^{chars}]+", ""))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words() -> Column:
    bare = F.btrim(_text(), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def _windows() -> Column:
    at = F.sequence(F.lit(0), F.size("words") - _WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(_WINDOW)]))
    return F.when(F.size("words") < _WINDOW, F.array().cast("array<bigint>")).otherwise(hashes)


def _sorted_windows() -> Column:
    """Windows by hash, then place, for texts in which any stands twice; else null."""
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed))


def _repeated() -> Column:
    """Words of windows that stand twice or more: equal windows are neighbours once sorted."""
    s = F.col("sorted_windows")
    both = lambda a, b: F.when(a["h"] == b["h"], F.array(*[x["i"] + k for x in (a, b) for k in range(_WINDOW)])).otherwise(F.array().cast("array<int>"))
    return F.when(s.isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(F.zip_with(s, F.slice(s, 2, F.size(s)), both)))))


#: What several measures share: name -> (what it is made of, the column).
PARTS = {
    "words": ((), _words),
    "lines": ((), lambda: F.filter(F.split(_text(), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")),
    "windows": (("words",), _windows),
    "sorted_windows": (("windows",), _sorted_windows),
}
#: Numbers of a text (long): name -> (the parts it is made of, the column).
MEASURES = {
    "n_words": (("words",), lambda: F.size("words")),
    "word_chars": (("words",), lambda: F.length(F.array_join("words", ""))),
    "n_symbols": ((), lambda: _count(SYMBOLS)),
    "n_lines": (("lines",), lambda: F.size("lines")),
    "n_dup_lines": (("lines",), lambda: F.size("lines") - F.size(F.array_distinct("lines"))),
    "n_repeat_words": (("sorted_windows",), _repeated),
    "n_digits": ((), lambda: _count("0-9")),
    "n_capitals": ((), lambda: _count("A-Z")),
    "longest_word": (("words",), lambda: F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0))),
}


@dataclass(frozen=True)
class Rule:
    """Rejects texts by a condition (SQL over ``measures``) that is never null."""

    name: str
    measures: tuple[str, ...]
    rejects: str


BASE = (
    Rule("few_words", ("n_words",), f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words"),
)
OWN = (
    Rule("symbols", ("n_words", "n_symbols"), f"100 * n_symbols > {SYMBOL_PERCENT} * n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), f"100 * n_dup_lines > {DUPLICATE_LINE_PERCENT} * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), f"word_chars < {SHORT_WORDS} * n_words OR word_chars > {LONG_WORDS} * n_words"),
    Rule("digits", ("word_chars", "n_digits"), f"100 * n_digits > {DIGIT_PERCENT} * word_chars"),
    Rule("capitals", ("word_chars", "n_capitals"), f"100 * n_capitals > {CAPITAL_PERCENT} * word_chars"),
    Rule("longest_word", ("longest_word",), f"longest_word > {LONGEST_WORD}"),
)
RULES = BASE + OWN


def needed(names: Sequence[str]) -> list[str]:
    """The parts of the named parts and measures, and the names themselves, each after what it is made of."""
    out: list[str] = []

    def visit(name: str) -> None:
        for part in (PARTS.get(name) or MEASURES[name])[0]:
            visit(part)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def _column(name: str) -> Column:
    return PARTS[name][1]() if name in PARTS else MEASURES[name][1]().cast("long")


def measured(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``texts`` (text, ...) with the named measures and parts, for every row."""
    for name in needed(names):
        texts = texts if name in texts.columns else texts.withColumn(name, _column(name))
    return texts


@dataclass
class Profile:
    """What a sample says: seconds for each part and measure, and how many rows each set of rules rejects."""

    seconds: dict[str, float] = field(default_factory=dict)
    rejected: list[tuple[tuple[bool, ...], int]] = field(default_factory=list)
    rules: tuple[Rule, ...] = ()

    def order(self) -> list[Rule]:
        """Rules by rejection per cost, each next one chosen among the rows that the earlier ones leave.

        What earlier rules have computed costs nothing more. Equal rules stay in the order given.
        """
        left, rows, have, out = list(range(len(self.rules))), list(self.rejected), set(), []

        def gain(k: int) -> float:
            cost = sum(self.seconds.get(x, 0.0) for x in needed(self.rules[k].measures) if x not in have)
            return sum(n for bad, n in rows if bad[k]) / max(cost, 1e-6)

        while left:
            k = max(left, key=lambda k: (gain(k), -k))
            left.remove(k)
            out.append(self.rules[k])
            have.update(needed(self.rules[k].measures))
            rows = [(bad, n) for bad, n in rows if not bad[k]]
        return out


def profile(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, text_col: str = "text") -> Profile:
    """Costs and selectivities on a random sample of about ``rows`` rows: whole texts, written once to shared storage.

    A cost is the time of a job that computes one part or measure over the sample, less that of the job without it. What comes
    to the driver is a count for each combination of rejecting rules that the sample has, so ``rows`` at most.
    """
    n = docs.count()
    if not n:
        return Profile(rules=tuple(rules))
    sample = stash(docs.select(F.col(text_col).alias("text")).sample(min(1.0, rows / n), seed=0), "sample", release=False)
    names = needed([m for r in rules for m in r.measures])
    every = measured(sample, names).select(*[F.expr(r.rejects).alias(f"r{k}") for k, r in enumerate(rules)])
    found = every.groupBy(*every.columns).count().collect()
    total: dict[str, float] = {"": 0.0}
    for name in ["", "", *names]:  # the first run of all warms up
        table = measured(sample, [name]) if name else sample
        kind = table.schema[name].dataType.typeName() if name else ""
        value = F.size(name) if kind == "array" else F.col(name) if name else F.length("text")
        began = time.perf_counter()
        table.agg(F.sum(value)).collect()
        total[name] = time.perf_counter() - began
    least = lambda name: max([total[p] for p in needed([name])[:-1]], default=total[""])
    return Profile({name: max(1e-4, total[name] - least(name)) for name in names}, [(tuple(r)[:-1], r["count"]) for r in found], tuple(rules))


def cascade(docs: DataFrame, rules: Sequence[Rule], always: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs``), failed (the first rule in this order that rejects, or null), kept, and the measures.

    A rule's parts and measures are computed for the rows that no earlier rule has rejected; for the others they are null,
    unless ``always`` asks for them. So the verdict doesn't depend on the order, ``failed`` does. How many rows each rule rejects
    is observed (as quality_rules_...); filters on the verdict stay above that, where they don't copy the chain of conditions.
    """
    names, forced = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), set(needed(always))
    out = names.withColumn("failed", F.lit(None).cast("string"))
    for name in needed(always):
        out = out.withColumn(name, _column(name))
    for rule in rules:
        for name in needed(rule.measures):
            if name not in out.columns:
                out = out.withColumn(name, F.when(F.col("failed").isNull(), _column(name)))
        out = out.withColumn("failed", F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.expr(rule.rejects), F.lit(rule.name)))
    wanted = needed([*always, *(m for r in rules for m in r.measures)])
    return out.observe(f"quality_rules_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("failed") == r.name).alias(r.name) for r in rules]).select("row", "failed", F.col("failed").isNull().alias("kept"), *[n for n in wanted if n in MEASURES])


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, always: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """``cascade`` in the order that a sample of ``docs`` suggests.

    A null text counts as empty: it has no words and fails ``few_words``. Whole texts are measured: each row in one task, its
    words and windows in memory (some 200 bytes for each word). Equal windows are found by 64-bit hashes within one text.
    Repeated rows, null ids and extra columns of any name are kept as they are; an empty table gives an empty result. There is no
    shuffle.
    """
    return cascade(docs, profile(docs, rules, text_col=text_col).order(), always, text_col)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` (text, ...) that no rule rejects, with its columns."""
    return quality_rules(docs, rules).where("kept").select("row.*")


BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All rules over all documents: doc_id, the base measures, base_failed, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in BASE))
    return quality_rules(docs, always=BASE_MEASURES).select("row.doc_id", *BASE_MEASURES, failed.alias("base_failed"), "kept")


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, unnest(range(0, len(w) - 2)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d WHERE len(w) > 2),
p AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
c AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(translate(t, '0123456789', '')) AS n_digits, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
  coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word FROM d LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(f"({r.rejects})" for r in BASE)} AS base_failed,
  NOT ({" OR ".join(f"({r.rejects})" for r in RULES)}) AS kept FROM m
"""
