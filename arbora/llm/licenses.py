"""License scans: base phrases, and notices matched by token automata compiled from templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.words import blocks

#: Phrases whose every place counts, and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> template. ``[...]`` is optional, ``<a|b>`` takes one of several wordings, ``{m,n}`` is replaceable: m to n words of
#: any kind. All other words are mandatory, in this order. A template begins and ends with mandatory or alternative words.
TEMPLATES = {
    "apache-2.0": "licensed under [the terms of] the apache license [version] 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted [subject to the limitations in the disclaimer below] provided that the following conditions are met",
    "cc-by-4.0": "licensed under [a] <cc by|creative commons attribution> 4 0",
    "cc-by-nc-4.0": "licensed under [a] <cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial> 4 0",
    "cc-by-sa-4.0": "licensed under [a] <cc by sa|creative commons attribution sharealike> 4 0",
    "copyright-notice": "copyright [c] {1,8} all rights reserved",
    "gpl-3.0": "<licensed under|redistribute it and or modify it under> [the terms of] the gnu general public license [as published by the free software foundation] [either] version 3",
    "isc": "permission to use copy modify and [or] distribute this software [and its documentation] for any purpose with or without fee is hereby granted",
    "mit": "<released|licensed|distributed|available> under [the terms of] the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <software|{1,3}> to deal in the <software|{1,3}> without restriction",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "spdx-tag": "spdx license identifier {1,1}",
}

# Byte -> byte: A-Z are lowered, digits, a-z and all bytes of non-ASCII characters stay, the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_TOKEN = re.compile(r"\[|\]|<|>|\||\{\d+,\d+\}|[^\s\[\]<>|{}]+")


class Automaton:
    """A nondeterministic automaton over words. States are numbers; ``steps`` has (word or None for any word, next state)."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[bytes | None, int]]] = []
        self.free: list[list[int]] = []
        tokens = _TOKEN.findall(template)
        self.start = self._state()
        self.end, at = self._sequence(tokens, 0, self.start)
        if at != len(tokens):
            raise ValueError(f"unbalanced template: {template}")
        self.first = {w for s in self._closed({self.start}) for w, _ in self.steps[s]}
        if None in self.first or self.end in self._closed({self.start}):
            raise ValueError(f"a template must begin with a mandatory word: {template}")

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _sequence(self, tokens: list[str], at: int, state: int) -> tuple[int, int]:
        while at < len(tokens) and tokens[at] not in "]>|":
            token, after = tokens[at], self._state()
            if token == "[":
                end, at = self._sequence(tokens, at + 1, state)
                self.free[end].append(after)
                self.free[state].append(after)
            elif token == "<":
                while tokens[at] != ">":
                    own = self._state()
                    self.free[state].append(own)
                    end, at = self._sequence(tokens, at + 1, own)
                    self.free[end].append(after)
            elif token[0] == "{":
                low, high = map(int, token[1:-1].split(","))
                here = state
                for i in range(high):
                    if i >= low:
                        self.free[here].append(after)
                    then = self._state()
                    self.steps[here].append((None, then))
                    here = then
                self.free[here].append(after)
            else:
                self.steps[state].append((token.encode(), after))
            state, at = after, at + 1
        return state, at

    def _closed(self, states: set[int]) -> set[int]:
        todo, done = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in done:
                    done.add(s)
                    todo.append(s)
        return done

    def longest(self, words: Iterator[bytes]) -> int:
        """How many leading words the longest accepted run has; 0 if none is accepted."""
        states, best = self._closed({self.start}), 0
        for n, word in enumerate(words, 1):
            states = self._closed({to for s in states for w, to in self.steps[s] if w is None or w == word})
            if not states:
                break
            if self.end in states:
                best = n
        return best


@lru_cache(8)
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton, list[bytes]]]:
    return [(label, a, [b" " + w + b" " for w in sorted(a.first)]) for label, t in templates for a in [Automaton(t)]]


def normalized(text: str | None) -> bytes:
    """The words of a text, each with a space before it and after it; one space if there are none."""
    data = (text or "").encode().translate(_WORD_BYTES)
    body = b" ".join(x for part in blocks(data) if (x := b" ".join(part.split())))
    return b" " + body + b" " if body else b" "


def _places(buf: bytes, phrase: bytes) -> Iterator[tuple[int, int]]:
    """(byte, word) of each place of a space-enclosed phrase."""
    at, word, since = buf.find(phrase), 0, 0
    while at >= 0:
        word += buf.count(b" ", since, at)
        since = at
        yield at, word
        at = buf.find(phrase, at + 1)


def _words_from(buf: bytes, at: int) -> Iterator[bytes]:
    while (end := buf.find(b" ", at + 1)) > 0:
        yield buf[at + 1 : end]
        at = end


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items()), base: tuple[tuple[str, str], ...] = tuple(BASE.items())) -> tuple[int, list[tuple[str, int, int, bool]]]:
    """Number of words, and (label, first word, end word, is base) for each place of a phrase and each accepted notice."""
    buf = normalized(text)
    found = []
    for phrase, label in base:
        n = phrase.count(" ") + 1
        found += [(label, w, w + n, True) for _, w in _places(buf, b" " + phrase.encode() + b" ")]
    for label, automaton, firsts in _compiled(templates):
        for first in firsts:
            for at, w in _places(buf, first):
                if n := automaton.longest(_words_from(buf, at)):
                    found.append((label, w, w + n, False))
    return buf.count(b" ") - 1, sorted(found, key=lambda x: (x[1], x[2], x[0]))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, spans array<struct<label, first_word, end_word, base>>: one row for each row of ``docs``.

    ASCII capitals are lowered; words are runs of ASCII letters and digits and of all characters beyond ASCII. A template's
    automaton runs from every place of a word that can begin it, over whole texts, and the longest accepted run counts; one
    wrong, missing or added mandatory word rejects it. Null texts count as empty. Repeated rows and null ids are kept as they
    are; extra columns are ignored. There is no shuffle.
    """
    own = tuple((TEMPLATES if templates is None else templates).items())

    @F.arrow_udf("struct<n_words: long, spans: array<struct<label: string, first_word: long, end_word: long, base: boolean>>>")
    def run(texts: pa.Array) -> pa.Array:
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("base", pa.bool_())])
        rows = [scan(t.as_py(), own) for t in texts]
        spans = [[dict(zip(("label", "first_word", "end_word", "base"), s)) for s in x] for _, x in rows]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array(spans, pa.list_(span))], ["n_words", "spans"])

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents. ``score``: 1 with a whole notice, 0.5 with a phrase alone, else 0."""
    s = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, own = F.filter("spans", lambda x: x["base"]), F.filter("spans", lambda x: ~x["base"])
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    starts = F.transform(base, lambda y: y["first_word"])
    return s.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names("spans").alias("labels"), F.when(F.size(own) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s,
  list_filter(range(1, len(w)), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS c,
  list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g,
  list_filter(range(1, len(w) - 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS r FROM d),
l AS (SELECT doc_id, w, list_concat(list_concat(c, g), r) AS b,
  list_filter([CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS bl,
  list_filter([
    CASE WHEN regexp_matches(s, ' licensed under (the terms of )?the apache license (version )?2 0 ') THEN 'apache-2.0' END,
    CASE WHEN regexp_matches(s, ' redistribution and use in source and binary forms with or without modification are permitted (subject to the limitations in the disclaimer below )?provided that the following conditions are met ') THEN 'bsd' END,
    CASE WHEN regexp_matches(s, ' licensed under (a )?(cc by|creative commons attribution) 4 0 ') THEN 'cc-by-4.0' END,
    CASE WHEN regexp_matches(s, ' licensed under (a )?(cc by nc|creative commons attribution non ?commercial) 4 0 ') THEN 'cc-by-nc-4.0' END,
    CASE WHEN regexp_matches(s, ' licensed under (a )?(cc by sa|creative commons attribution sharealike) 4 0 ') THEN 'cc-by-sa-4.0' END,
    CASE WHEN regexp_matches(s, ' copyright (c )?([^ ]+ ){1,8}all rights reserved ') THEN 'copyright-notice' END,
    CASE WHEN regexp_matches(s, ' (licensed under|redistribute it and or modify it under) (the terms of )?the gnu general public license (as published by the free software foundation )?(either )?version 3 ') THEN 'gpl-3.0' END,
    CASE WHEN regexp_matches(s, ' permission to use copy modify and (or )?distribute this software (and its documentation )?for any purpose with or without fee is hereby granted ') THEN 'isc' END,
    CASE WHEN regexp_matches(s, ' (released|licensed|distributed|available) under (the terms of )?the mit license ') THEN 'mit' END,
    CASE WHEN regexp_matches(s, ' permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the ([^ ]+ ){1,3}to deal in the ([^ ]+ ){1,3}without restriction ') THEN 'mit-text' END,
    CASE WHEN regexp_matches(s, ' subject to the terms of the mozilla public license v 2 0 ') THEN 'mpl-2.0' END,
    CASE WHEN regexp_matches(s, ' spdx license identifier [^ ]+ ') THEN 'spdx-tag' END], lambda x: x IS NOT NULL) AS ol FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(b) - 1 AS BIGINT) AS first_word, CAST(list_max(b) - 1 AS BIGINT) AS last_word,
  array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_concat(bl, ol)), ',') AS labels,
  CASE WHEN len(ol) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l
"""
