"""Periodic runs of words, found on a Re-Pair grammar of the word ids."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.words import word_lists

#: A run is at least so many periods long, and at least so many words.
PERIODS = 4
LEAST = 6
#: Candidate periods of several nonterminals are tested together, about so many at a time.
TESTS = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 1


def stretches(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold runs: within one, every word stands ``periods`` times or more.

    Each word of a run recurs in it, once a period; so words that are rarer within a stretch than that cut it, until none is.
    """
    todo = [(0, len(ids))]
    while todo:
        start, end = todo.pop()
        if end - start < least:
            continue
        _, at, count = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], count[at] >= periods, [False]]).astype(np.int8)))
        if len(edge) == 2 and edge[1] - edge[0] == end - start:
            yield start, end
        else:
            todo += [(start + a, start + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def repair(ids: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """(sequence, rules) of Re-Pair: the commonest pair of neighbours becomes a new symbol, until no pair stands twice.

    Of equally common pairs the one seen first is taken, so that equal passages get grammars of small height. Places of a pair
    that overlap (in a row of equal symbols) count once for each two symbols, and a row that has lost its first symbol may count
    one less. New symbols are numbers above all ids.
    """
    n, symbol = len(ids), list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    order: dict[tuple[int, int], int] = {}
    heap: list[tuple[int, int, tuple[int, int]]] = []

    def offer(pair: tuple[int, int]) -> None:
        if len(places[pair]) > 1:
            heapq.heappush(heap, (-len(places[pair]), order.setdefault(pair, len(order)), pair))

    def add(i: int) -> tuple[int, int] | None:
        j = after[i]
        if j >= n:
            return None
        pair = symbol[i], symbol[j]
        if symbol[i] == symbol[j] and (before[i] in places[pair] or j in places[pair]):
            return None  # overlaps the place before or after
        places[pair].add(i)
        return pair

    for i in range(n - 1):
        add(i)
    for pair in list(places):
        offer(pair)
    rules: dict[int, tuple[int, int]] = {}
    new = max(ids, default=0) + 1
    while heap:
        count, _, pair = heapq.heappop(heap)
        if len(places[pair]) != -count:  # grown or shrunk since
            if 1 < len(places[pair]) < -count:
                offer(pair)
            continue
        rules[new] = pair
        touched, freed = [], []
        for i in sorted(places.pop(pair)):
            j = after[i]
            if j >= n or (symbol[i], symbol[j]) != pair:
                continue
            h, k = before[i], after[j]
            if h >= 0:
                places[symbol[h], symbol[i]].discard(h)
                if symbol[h] == symbol[i]:
                    freed.append(before[h])
            if k < n:
                places[symbol[j], symbol[k]].discard(j)
                before[k] = i
                if symbol[j] == symbol[k]:
                    freed.append(k)  # no place overlaps it any more
            symbol[i], symbol[j], after[i] = new, -1, k
            touched.append(i)
        grown = {p for k in freed if k >= 0 and symbol[k] >= 0 and (p := add(k))}
        for i in touched:
            if before[i] >= 0 and (p := add(before[i])):
                grown.add(p)
            if p := add(i):
                grown.add(p)
        for p in sorted(grown, key=lambda p: min(places[p])):
            offer(p)
        new += 1
    out, i = [], 0
    while i < n:
        out.append(symbol[i])
        i = after[i]
    return out, rules


class Grammar:
    """The derivation tree of a sequence: Re-Pair's rules, and a balanced tree over the symbols that are left.

    ``left``, ``middle``, ``right``: of each nonterminal, its first place in the sequence, where its second part begins there,
    and its end. ``places`` are all starts of what a nonterminal derives.
    """

    def __init__(self, ids: np.ndarray):
        top, rules = repair(ids.tolist())
        size: dict[int, int] = {}
        for x, (a, b) in rules.items():  # parts come before what is made of them
            size[x] = size.get(a, 1) + size.get(b, 1)
        starts = np.concatenate([[0], np.cumsum([size.get(s, 1) for s in top])])
        spans: list[tuple[int, int, int]] = []
        self.places: list[list[int]] = []
        todo = [(0, len(top))]
        while todo:  # each node over the top symbols is derived once
            a, b = todo.pop()
            if b - a > 1:
                m = (a + b) // 2
                spans.append((int(starts[a]), int(starts[m]), int(starts[b])))
                self.places.append([int(starts[a])])
                todo += [(a, m), (m, b)]
        at: dict[int, list[int]] = defaultdict(list)
        for s, start in zip(top, starts[:-1].tolist()):
            if s in rules:
                at[s].append(start)
        for x in reversed(rules):  # what derives x comes before x
            a, b = rules[x]
            mid = size.get(a, 1)
            if a in rules:
                at[a] += at[x]
            if b in rules:
                at[b] += [p + mid for p in at[x]]
            first = at[x][0]
            spans.append((first, first + mid, first + size[x]))
            self.places.append(at[x])
        self.left, self.middle, self.right = (np.array(c, np.int64) for c in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3


class _Equal:
    """Whether two ranges of a sequence are likely equal, by one hash each; what is likely is checked afterwards."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            self.power = np.full(n + 1, _ODD, np.uint64)
            self.power[0] = 1
            self.power = np.multiply.accumulate(self.power)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.power[:n])])

    def shifted(self, start: np.ndarray, length: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Whether the range and the one ``by`` further on are equal."""
        one = self.sums[start + length] - self.sums[start]
        return one * self.power[by] == self.sums[start + by + length] - self.sums[start + by]


def _stretch(ids: np.ndarray, low: int, high: int, seed: int, period: int) -> tuple[int, int]:
    """The longest stretch of a period within low..high around two equal words at ``seed`` and one period on; by comparison."""

    def matches(start: int, step: int) -> int:
        n, size = 0, 64
        while True:
            a = start + n if step > 0 else start - n
            room = min(size, high - period - a if step > 0 else a - low + 1)
            if room <= 0:
                return n
            x = slice(a, a + room) if step > 0 else slice(a - room + 1, a + 1)
            wrong = np.flatnonzero(ids[x] != ids[x.start + period : x.stop + period])
            if len(wrong):
                return n + int(wrong[0] if step > 0 else room - 1 - wrong[-1])
            n, size = n + room, size * 2

    return seed - matches(seed, -1) + 1, seed + matches(seed, 1) + period


def crossing(ids: np.ndarray, left: int, middle: int, right: int, periods: np.ndarray, seeds: np.ndarray, need: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs of one nonterminal that cross its boundary, for candidate periods in ascending order.

    ``seeds``: a place for each candidate from which two periods and a word were found likely to repeat after one period; it
    stands at the last word before the boundary, or one period before that. A candidate whose two periods lie within a stretch
    of a smaller period is no smallest period, and its run is that stretch.
    """
    first = np.where(seeds < middle - 1, seeds - periods, seeds)  # seeds on the boundary reach right, the others left
    last = first + 2 * periods
    while len(periods):
        q = int(periods[0])
        a, b = _stretch(ids, left, right, int(seeds[0]), q)
        inside = (first >= a) & (last < b)
        if inside[0]:  # else the hashes were wrong
            if b - a >= max(least, need * q):
                yield a, b, q
        else:
            inside[:] = False
            inside[0] = True
        periods, seeds, first, last = (x[~inside] for x in (periods, seeds, first, last))


def grammar_runs(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence, by start, then period.

    Every run crosses the boundary between the two parts of exactly one smallest nonterminal that derives all of it, so each
    nonterminal is searched once, at its boundary, on its first place. A run of ``periods`` (4 at least) has two periods on one
    side of the boundary: one comparison of hashes a period and side finds the candidates, which are then extended word by
    word. What is found counts at every place where the nonterminal stands; of stretches of one period that lie within each
    other, the longest is the run.
    """
    if periods < 4:
        raise ValueError("at least four periods: one side of a boundary must hold two of them")
    tree, equal = Grammar(ids), _Equal(ids)
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    size = tree.right - tree.left
    sides = [np.minimum(size // periods, room // 2) for room in (tree.right - tree.middle, tree.middle - tree.left)]
    node, done = 0, len(size)
    total = np.cumsum(sides[0] + sides[1])
    while node < done:
        end = max(node + 1, int(np.searchsorted(total, TESTS + (total[node - 1] if node else 0), side="right")))
        cand = []
        for side, most in enumerate(sides):
            own = np.repeat(np.arange(node, end), most[node:end])
            q = np.arange(len(own)) - np.repeat(np.cumsum(most[node:end]) - most[node:end], most[node:end]) + 1
            border = tree.middle[own] - 1
            start = border - q * side  # to the right of the boundary, or to the left of it
            ok = start - q * side >= tree.left[own]
            ok &= start + q * (1 if side else 2) < tree.right[own]
            own, q, start = own[ok], q[ok], start[ok]
            ok = ids[start] == ids[start + q]
            own, q, start = own[ok], q[ok], start[ok]
            ok = equal.shifted(start - q * side, q + 1, q)
            cand.append((own[ok], q[ok], start[ok]))
        own, q, start = (np.concatenate(c) for c in zip(*cand))
        order = np.lexsort((start, q, own))
        own, q, start = own[order], q[order], start[order]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
            x = int(own[a])
            low, mid, high = int(tree.left[x]), int(tree.middle[x]), int(tree.right[x])
            for s, e, p in crossing(ids, low, mid, high, q[a:b], start[a:b], periods, least):
                found[p].update((at + s - low, at + e - low) for at in tree.places[x])
        node = end
    out = []
    for p, spans in found.items():
        reach = -1
        for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
            if e > reach:
                out.append((s, e, p))
                reach = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word ids, by start, then period.

    A run is a stretch of smallest period q, of ``periods`` * q words or more and ``least`` at least, that no neighbour extends.
    """
    out = []
    for a, b in stretches(ids, periods, least):
        out += [(a + s, e - s, p) for s, e, p in grammar_runs(ids[a:b], periods, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: not those that a run has after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with a periodic tail, for a tenth of all numbers ``h``; the rest, and null, leave them as they are."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def _found(text: str | None, h: int | None) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    words = planted([w for part in word_lists((text or "").encode()) for w in part], h)
    if len(words) < LEAST:
        return words, []
    ids = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()
    return words, runs(ids)


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties to the smaller start, then the smaller period."""
    top = None
    for r in found:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


_DIGEST = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def run_digest(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256: one row for each row of ``docs``.

    A null text and one without words have no runs; start to exponent_milli are null where there are none; the digests are then
    those of the empty string and of all words. With ``plant`` the words of a tenth of the ids, by their CRC, get a periodic tail
    first; rows without an id are left alone. Repeated rows come back repeated, extra columns are ignored, an empty table gives
    an empty result. There is no shuffle; a text is held whole, with about 100 bytes for each word that can lie in a run.
    """

    @F.arrow_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    def digest(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = []
        for text, h in zip(texts, hashes):
            words, found = _found(text.as_py(), h.as_py())
            top = best(found)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
            stay = [w for w, k in zip(words, kept(len(words), found).tolist()) if k] if found else words
            rows.append((len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(stay)).hexdigest()))
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _DIGEST)] if rows else [pa.array([], kind) for _, kind in _DIGEST], [name for name, _ in _DIGEST])

    h = F.crc32(F.col(id_col).cast("string").cast("binary")) if plant else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col), h).alias("d")).select("doc_id", "d.*")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, period: each run of each text, words numbered from 0. Texts without runs give no row."""

    @F.arrow_udf("array<struct<start: long, length: long, period: long>>")
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.array([[dict(zip(("start", "length", "period"), r)) for r in _found(t.as_py(), None)[1]] for t in texts], kind)

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found(F.col(text_col))).alias("r")).select("doc_id", "r.*")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run of its texts cut to its first period; the words of a text that changes are joined by single spaces.

    Null texts and texts without runs stay as they are, as do all other columns; their names don't matter.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words, found = _found(t.as_py(), None)
            out.append(b" ".join(w for w, k in zip(words, kept(len(words), found).tolist()) if k).decode() if found else t.as_py())
        return pa.array(out, pa.string())

    row = docs.select(F.struct("*").alias("row"))
    return row.select(F.col("row").withField(text_col, cut(F.col("row")[text_col])).alias("row")).select("row.*")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of four periods and more in all documents, periodic tails planted in a tenth of them."""
    return run_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
