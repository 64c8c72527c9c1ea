"""SentencePiece segmentations sampled without replacement, and decoding.

A text's segmentations are the paths of its lattice. A path has the probability of its pieces' product, normalised over all
paths. Perturbing every path's log probability with Gumbel noise and taking the k largest samples k distinct paths without
replacement; the search below finds them best first without listing the paths (Gumbel top-k, Kool et al. 2019; A* sampling,
Maddison et al. 2014).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 3
#: Characters of the texts that are sampled together (a longer text on its own), and chunks that are walked at once.
BATCH_CHARS = 300_000
WALKS = 1 << 16
#: Characters of distinct chunks whose lattices a Python worker keeps, and the scale of a character's mass (a typical log).
CACHED_CHARS = 1_000_000
SCALE = 8.0
SPACE = "▁"
_U = np.uint64
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

ROW = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decodes boolean"


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashes."""
    return ((_mix(x) >> _U(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _seeds(x: np.ndarray, *codes: int) -> np.ndarray:
    """Seeds of independent streams from other seeds."""
    for c in codes:
        x = _mix(x ^ _U(0x9E3779B97F4A7C15 * (c + 1) & (1 << 64) - 1))
    return x


class Pieces:
    """The vocabulary of a model, with a log probability for each piece.

    A unigram model's scores are log probabilities. A BPE model has ranks only (its scores are 0, -1, ...): there the piece of
    rank r has probability proportional to 1 / (r + 1). Characters without a piece fall back to their bytes' pieces, which have
    the probability after the last rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(m)
        self.normalize: Callable[[str], str] = m.normalize
        names = [m.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        self.decoded = [b""] * n
        usual = []
        for i, name in enumerate(names):
            if m.is_byte(i):
                self.byte_id[int(name[1:-1], 16)] = i
                self.decoded[i] = bytes([int(name[1:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                usual.append(i)
                self.decoded[i] = name.replace(SPACE, " ").encode()
        self.decoded_bytes = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.decoded_sizes = np.array([len(x) for x in self.decoded], np.int64)
        self.decoded_at = np.cumsum(self.decoded_sizes) - self.decoded_sizes
        scores = np.array([m.get_score(i) for i in usual])
        if scores.min() <= -len(usual) / 2:  # ranks
            top = np.log(1 / np.arange(1, len(usual) + 2)).astype(float)
            logs, self.byte_log = -np.log1p(-scores), float(-np.log(len(usual) + 1))
            logs, self.byte_log = logs - np.logaddexp.reduce(top), self.byte_log - np.logaddexp.reduce(top)
        else:
            logs, self.byte_log = scores, float(scores.min())
        self.logs = np.full(n, self.byte_log)
        self.logs[usual] = logs
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in usual):
            raise ValueError("pieces that go on past a space are not supported")
        self.names = {names[i]: i for i in usual}
        self.longest = max(map(len, self.names), default=0)
        self.kept: Lattice | None = None
        known: dict[int, int] = {}
        for name, i in self.names.items():
            chars = np.frombuffer(name.encode("utf-32-le"), "<u4").astype(_U)
            begun = np.cumsum(_mix(chars + (np.arange(1, len(chars) + 1).astype(_U) << _U(32)))).tolist()
            for h in begun[:-1]:
                known.setdefault(h, -1)
            known[begun[-1]] = i
        self.mask = (1 << (4 * len(known)).bit_length()) - 1
        self.slots, self.values = np.zeros(self.mask + 1, _U), np.full(self.mask + 1, -2, np.int64)
        for h, i in known.items():
            at = h & self.mask
            while self.values[at] != -2:
                at = at + 1 & self.mask
            self.slots[at], self.values[at] = h, i

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, -1 for the beginning of longer pieces, -2 for neither: linear probing in one table."""
        at = (h & _U(self.mask)).astype(np.int64)
        out = self.values[at]
        wrong = np.flatnonzero((self.slots[at] != h) & (out != -2))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & self.mask
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(self.slots[at[wrong]] != h[wrong]) & (out[wrong] != -2)]
        return out

    def lattice(self) -> Lattice:
        """The lattices kept so far, or none if they have grown too large; that costs time and changes nothing."""
        if self.kept is None or len(self.kept.chars) > CACHED_CHARS:
            self.kept = Lattice(self)
        return self.kept

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut before each run of spaces: no piece goes on past such a cut."""
        return _RUNS.findall(self.normalize(text).replace(" ", SPACE)) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.decoded.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")

    def decodes(self, ids: np.ndarray, want: bytes) -> bool:
        """Whether the ids give back the text, some at a time."""
        at = 0
        for start in range(0, len(ids), 1 << 18):
            some = ids[start : start + (1 << 18)]
            sizes = self.decoded_sizes[some]
            data = self.decoded_bytes[np.arange(sizes.sum()) + np.repeat(self.decoded_at[some] - (np.cumsum(sizes) - sizes), sizes)].tobytes()
            data = data[1:] if start == 0 and data[:1] == b" " else data
            if not want.startswith(data, at):
                return False
            at += len(data)
        return at == len(want)


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class _Numbers(dict):
    """Numbers chunks as they come, and remembers those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = n = len(self)
        return n


class Lattice:
    """The lattices of all chunks seen so far, side by side: a state is a character's place, an edge a piece that starts there.

    first: each chunk's first state. edges_at: each state's first edge. start, target, ids: an edge's states (-1 for the end of
    the chunk) and piece (-w for a character of w bytes without one). log: its log probability among all ways on from its
    state; others: that of the state's other edges, -inf if it has none; reach: the sum of probabilities up to it.
    """

    KINDS = {"first": np.int64, "chars": np.uint32, "edges_at": np.int64, "start": np.int32, "target": np.int32, "ids": np.int32, "log": np.float64, "others": np.float64, "reach": np.float64}

    def __init__(self, vocab: Pieces):
        self.vocab, self.numbers, self.buffers = vocab, _Numbers(), {}
        for name, kind in self.KINDS.items():
            self.buffers[name] = np.zeros(1024, kind)
            setattr(self, name, self.buffers[name][: int(name == "edges_at")])

    def _append(self, name: str, new: np.ndarray) -> None:
        used, buffer = len(getattr(self, name)), self.buffers[name]
        if used + len(new) > len(buffer):
            buffer = self.buffers[name] = np.concatenate([buffer[:used], np.zeros(max(used, len(new)), buffer.dtype)])
        buffer[used : used + len(new)] = new
        setattr(self, name, buffer[: used + len(new)])

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks; lattices of new ones are built together."""
        rows = [np.array(list(map(self.numbers.__getitem__, self.vocab.chunks(t))), np.int32) for t in texts]
        if self.numbers.fresh:
            self._extend(self.numbers.fresh)
            self.numbers.fresh = []
        return rows

    def _extend(self, chunks: list[str]) -> None:
        vocab = self.vocab
        lengths = np.array([len(c) for c in chunks], np.int64)
        first = np.cumsum(lengths) - lengths
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        n = len(chars)
        left = np.repeat(first + lengths, lengths) - np.arange(n)
        found, covered = [], np.zeros(n, bool)
        at, h = np.arange(n), np.zeros(n, _U)
        for size in range(1, vocab.longest + 1):
            h = h + _mix(chars[at + size - 1].astype(_U) + _U(size << 32))
            got = vocab.look_up(h)
            hit = got >= 0
            if size == 1:
                covered[at[hit]] = True
            found.append((size, at[hit], got[hit]))
            on = (got > -2) & (left[at] > size)
            at, h = at[on], h[on]
            if not len(at):
                break
        bare = np.flatnonzero(~covered)
        c = chars[bare].astype(np.int64)
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        found.append((1, bare, np.where(width == 1, vocab.byte_id[np.minimum(c, 127)], -width)))
        choices = sum((np.bincount(at, minlength=n) for _, at, _ in found), np.zeros(n, np.int64))
        ends = np.cumsum(choices)
        start = np.repeat(np.arange(n), choices)
        ids, size, free = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), ends - choices
        for length, at, got in sorted(found, key=lambda x: -x[0]):  # long pieces first: they are often the likeliest
            to = free[at]
            ids[to], size[to] = got, length
            free[at] += 1
        logs = np.where(ids >= 0, vocab.logs[np.maximum(ids, 0)], -ids * vocab.byte_log)
        p = self._conditional(logs, start, size, left, np.repeat(np.arange(len(chunks)), lengths), ends)
        log, run = np.log(np.maximum(p, 1e-300)), np.cumsum(p)
        reach = run - (run - p)[ends - choices][start]
        reach[ends - 1] = np.inf
        others = np.full(len(p), -np.inf)
        many = np.flatnonzero(choices[start] > 1)
        others[many] = np.log(np.maximum(1 - p[many], 1e-16))
        states, edges = len(self.chars), len(self.start)
        target = np.where(left[start] == size, -1, states + start + size)
        for name, x in zip(self.KINDS, (states + first, chars, edges + ends, states + start, target, ids, log, others, reach)):
            self._append(name, x)

    @staticmethod
    def _conditional(logs: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, chunk: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The probability of each edge among all ways on from its state.

        Masses of all ways on are added up backwards from the ends, all states equally far from theirs at once. They are scaled
        by ``SCALE`` for each character, which keeps them in range for words; the few chunks that are too long or too rare for
        that are added up as logarithms.
        """
        scaled = logs + SCALE * size
        single = np.bincount(chunk, np.minimum(scaled[ends - 1], 0.0))  # a state's last edge is one character
        heavy = (single < -600) | (np.bincount(chunk) > 600 / SCALE)
        out = np.empty(len(logs))
        for some, linear in ((np.flatnonzero(~heavy[chunk[start]]), True), (np.flatnonzero(heavy[chunk[start]]), False)):
            if not len(some):
                continue
            own, x = start[some], np.exp(scaled[some]) if linear else scaled[some]
            far = left[own]
            to = np.where(far == size[some], -1, own + size[some])  # the last place stands for the end of every chunk
            mass = np.full(len(left) + 1, 1.0 if linear else 0.0)
            order = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")
            own, to, x, far = own[order], to[order], x[order], far[order]
            cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]]))
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            split = np.searchsorted(heads, cuts)
            for a, b, i, j in zip(cuts[:-1], cuts[1:], split[:-1], split[1:]):
                x[a:b] = x[a:b] * mass[to[a:b]] if linear else x[a:b] + mass[to[a:b]]
                mass[own[heads[i:j]]] = (np.add if linear else np.logaddexp).reduceat(x[a:b], heads[i:j] - a)
            out[some[order]] = x / mass[own] if linear else np.exp(x - mass[own])
        return out

    def walk(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all walks in order, index of each edge's walk): one random way to the end from each state."""
        alive, steps, count = np.arange(len(states)), [], np.zeros(len(states), np.int64)
        state = states
        while len(alive):
            u = _uniform(seeds[alive] + count[alive].astype(_U) * _U(0x9E3779B97F4A7C15))
            e = self.edges_at[state]
            short = np.flatnonzero(self.reach[e] <= u)
            while len(short):
                e[short] += 1
                short = short[self.reach[e[short]] <= u[short]]
            steps.append((alive, e))
            count[alive] += 1
            state = self.target[e]
            alive, state = alive[state >= 0], state[state >= 0]
        offset = np.cumsum(count) - count
        path = np.empty(int(count.sum()), np.int64)
        for k, (walk, e) in enumerate(steps):
            path[offset[walk] + k] = e
        return path, np.repeat(np.arange(len(states)), count)

    def ids_of(self, path: np.ndarray) -> np.ndarray:
        """Piece ids of a path; a character without a piece becomes its bytes' pieces."""
        ids = self.ids[path]
        if (ids >= 0).all():
            return ids
        parts, last = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            data = chr(int(self.chars[self.start[path[i]]])).encode()
            parts += [ids[last:i], self.vocab.byte_id[np.frombuffer(data, np.uint8)]]
            last = i + 1
        return np.concatenate([*parts, ids[last:]])


def _bounded(gumbel: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Gumbels conditioned on being below a bound; they keep their order."""
    return -np.logaddexp(-below, -gumbel)


def _gumbels(noise: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(noise)))


def _largest(g: np.ndarray, heads: np.ndarray, lengths: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segments, places): for each segment of ``g`` the place of its largest value, then the next, ``m`` times; -inf is none."""
    g, segment = g.copy(), np.repeat(np.arange(len(heads)), lengths)
    for _ in range(m):
        top = np.maximum.reduceat(g, heads)
        hit = np.flatnonzero((g == top[segment]) & (g > -np.inf))
        some, first = np.unique(segment[hit], return_index=True)
        yield some, hit[first]
        g[hit[first]] = -np.inf


def _best(m: int, *regions: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The ``m`` regions (Gumbel, owner, step, log probability and place there: a row for each text) of largest Gumbel, in order."""
    all_of_them = [np.concatenate(x, axis=1) for x in zip(*regions)]
    order = np.argsort(-all_of_them[0], axis=1, kind="stable")[:, :m]
    return tuple(np.take_along_axis(x, order, axis=1) for x in all_of_them)


class Sampler:
    """The samples of a batch of texts so far, and the best of the regions of paths that are left.

    A region holds the paths that share the first ``step`` edges of a sample, its owner, and leave it there by none of the
    edges tried. Its Gumbel is the largest of its paths' perturbed log probabilities, so a text's best region holds its next
    sample. After the nth of k samples only the best k - n + 1 regions can matter: one for each sample to come, one for the
    threshold. All texts take a step together, ``WALKS`` chunks at a time; of a text only its paths are kept.
    """

    def __init__(self, lattice: Lattice, rows: list[np.ndarray], seeds: list[int], k: int):
        self.lattice, self.seeds, self.k = lattice, np.array([x & (1 << 64) - 1 for x in seeds], _U), k
        self.ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.chunks = np.concatenate([np.zeros(0, np.int32), *rows])
        self.paths: list[list[np.ndarray]] = [[] for _ in rows]
        self.logs: list[list[float]] = [[] for _ in rows]
        self.perturbed: list[list[float]] = [[] for _ in rows]
        self.tried: dict[tuple[int, int, int], list[int]] = {}
        self.regions = self._none(1)

    def _none(self, m: int) -> tuple[np.ndarray, ...]:
        return tuple(np.full((len(self.seeds), m), x, kind) for x, kind in ((-np.inf, float), (0, np.int64), (0, np.int64), (0.0, float), (0, np.int64)))

    def run(self) -> None:
        texts = np.arange(len(self.seeds))
        bound = _gumbels(self.seeds)
        begun = [(np.zeros(0, np.int32), 0.0, *self._from(t, 0), -np.inf) for t in texts.tolist()]
        for nth in range(self.k):
            if nth:
                bound, *region = (x[:, 0] for x in self.regions)
                texts = np.flatnonzero(bound > -np.inf)
                luck = _uniform(_seeds(self.seeds[texts], 3, nth))
                begun = [self._leave(*x) for x in zip(luck.tolist(), texts.tolist(), *(x[texts].tolist() for x in region))]
            if not len(texts):
                return
            found = self._walk(nth, texts, bound[texts], begun)
            if nth:
                rest = np.array([x[-1] for x in begun]) + _gumbels(_seeds(self.seeds[texts], 9, nth))
                rest = _bounded(rest, bound[texts])[:, None]
                found = _best(self.k - nth, found, (rest, *(x[texts, None] for x in region)), tuple(x[texts, 1:] for x in self.regions))
            self.regions = self._none(self.k - nth)
            for x, y in zip(self.regions, found):
                x[texts] = y

    def _from(self, text: int, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, states) at the beginning of a text's chunks from a place on."""
        chunks = self.chunks[self.ends[text] + place : self.ends[text + 1]]
        return np.arange(place, place + len(chunks)), self.lattice.first[chunks]

    def _leave(self, u: float, text: int, owner: int, step: int, before: float, place: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, float]:
        """The sample that a region holds leaves the owner's path by an edge not tried before: (edges so far, their log
        probability, places and states to walk from, log mass of what is then left of the region)."""
        lattice, path = self.lattice, self.paths[text][owner]
        tried = self.tried.setdefault((text, owner, step), [int(path[step])])
        state = int(lattice.start[path[step]])
        low, high = int(lattice.edges_at[state]), int(lattice.edges_at[state + 1])
        left = [(e, math.exp(x)) for e, x in enumerate(lattice.log[low:high].tolist(), low) if e not in tried]
        u *= math.fsum(p for _, p in left)
        for edge, p in left:
            u -= p
            if u < 0:
                break
        tried.append(edge)
        rest = before + math.log(max(math.fsum(q for e, q in left if e != edge), 1e-300)) if len(left) > 1 else -math.inf
        places, states = self._from(text, place + 1)
        on = int(lattice.target[edge])
        if on >= 0:
            places, states = np.concatenate([[place], places]), np.concatenate([[on], states])
        return np.concatenate([path[:step], np.array([edge], np.int32)]), before + math.log(max(p, 1e-300)), places, states, rest

    def _walk(self, nth: int, texts: np.ndarray, bound: np.ndarray, begun: list[tuple]) -> tuple[np.ndarray, ...]:
        """Finish the texts' nth samples and return the best regions that leave them on the way."""
        lattice, m = self.lattice, self.k - nth
        log, step = np.array([x[1] for x in begun]), np.array([len(x[0]) for x in begun])
        parts = [[x[0]] for x in begun]
        row = np.repeat(np.arange(len(begun)), [len(x[2]) for x in begun])
        places, states = (np.concatenate([x[i] for x in begun]) for i in (2, 3))
        own, noise = (_seeds(self.seeds[texts], c, nth) for c in (7, 5))
        none = [x[texts] for x in self._none(m)]
        best = tuple(none)
        for a in range(0, len(row), WALKS):
            some = slice(a, a + WALKS)
            path, walk = lattice.walk(states[some], _mix(places[some].astype(_U) + own[row[some]]))
            each = row[some][walk]
            heads = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            here, lengths = each[heads], np.diff(np.append(heads, len(each)))
            logs = lattice.log[path]
            before = np.cumsum(logs) - logs
            before += np.repeat(log[here] - before[heads], lengths)
            steps = np.arange(len(path)) + np.repeat(step[here] - heads, lengths)
            g = before + lattice.others[path] + _gumbels(noise[each] + steps.astype(_U))
            found = [x.copy() for x in none]
            for i, (segment, top) in enumerate(_largest(g, heads, lengths, m)):
                for to, x in zip(found, (_bounded(g[top], bound[here[segment]]), nth, steps[top], before[top], places[some][walk[top]])):
                    to[here[segment], i] = x
            best = _best(m, best, tuple(found))
            for r, x in zip(here.tolist(), np.split(path.astype(np.int32), heads[1:])):
                parts[r].append(x)
            log[here] += np.add.reduceat(logs, heads)
            step[here] += lengths
        for r, t in enumerate(texts.tolist()):
            self.paths[t].append(np.concatenate(parts[r]))
            self.logs[t].append(float(log[r]))
            self.perturbed[t].append(float(bound[r]))
        return best

    def results(self, text: int) -> Iterator[tuple[np.ndarray, float, float, float]]:
        """(ids, log probability, perturbed one, inclusion score) of a text's samples, best first."""
        left = float(self.regions[0][text, 0])
        for path, log, perturbed in zip(self.paths[text], self.logs[text], self.perturbed[text]):
            yield self.lattice.ids_of(path), log, perturbed, 1.0 if left == -np.inf else float(-np.expm1(-np.exp(min(log - left, 700.0))))


def sample(vocab: Pieces, texts: list[str], seeds: list[int], k: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best first: (ids, log probability, perturbed one, inclusion score).

    The inclusion score is the probability that the path's Gumbel passes the threshold of the k samples, the largest perturbed
    log probability that was not taken (Kool et al. 2019); 1 if no path was left out. A text's samples depend on its seed and
    itself alone, not on the texts beside it.
    """
    lattice = vocab.lattice()
    sampler = Sampler(lattice, lattice.rows(texts), seeds, k)
    sampler.run()
    return (list(sampler.results(i)) for i in range(len(texts)))


def _row_seeds(ids: list[int | None], seed: int) -> list[int]:
    return _seeds(np.array([r or 0 for r in ids], np.int64).view(_U), seed).tolist()


def _runner(path: str, k: int, seed: int, keep_ids: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces_of(path)
        for batch in batches:
            rows, texts, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                rows.append(doc_id)
                texts.append(text)
                total += len(text)
                if total >= BATCH_CHARS:
                    yield group(vocab, rows, texts)
                    rows, texts, total = [], [], 0
            yield group(vocab, rows, texts)

    def group(vocab: Pieces, rows: list, texts: list[str]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8 + keep_ids)]
        for doc_id, text, got in zip(rows, texts, sample(vocab, texts, _row_seeds(rows, seed), k)):
            data = text.encode()
            for nth, (ids, log, perturbed, inclusion) in enumerate(got, 1):
                row = (doc_id, nth, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log, perturbed, inclusion, vocab.decodes(ids, data), ids)
                for x, y in zip(out, row):
                    x.append(y)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], [c.split()[0] for c in ROW.split(", ")] + ["ids"] * keep_ids)

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = 0, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each document and sample: see ``ROW``; with ``keep_ids`` also ids array<int>.

    ``sample`` counts from 1 in the order of the perturbed log probabilities. ``decodes`` tells whether the ids give back the
    text. A null or empty text has one segmentation, without pieces; a text of fewer than k segmentations gives all it has.
    Seeds come from the id, so repeated rows give equal samples; null ids count as 0. Extra columns are ignored. No shuffle.
    """
    run = _runner(path or piece_bpe_path(), k, seed, keep_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW + (", ids array<int>" if keep_ids else ""))


def decode_column(ids: str, path: str | None = None) -> Column:
    """The text of an array of ids; null for null."""
    path = path or piece_bpe_path()

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        vocab = pieces_of(path)
        return pa.array([vocab.decode(r.as_py()) if r.is_valid else None for r in rows], pa.string())

    return run(F.col(ids))


def op8_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    """Three distinct segmentations of every document, sampled without replacement, each decoded again."""
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
