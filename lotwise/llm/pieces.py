"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations form a lattice: an edge is a piece of the vocabulary, or one byte of a
character that has no piece. No piece reaches past the blank that starts a word, so the
lattice is a chain of word lattices. A piece of rank r weighs log(1 / (r + 2)) / temperature (the
vocabulary is ranked, Zipf's law gives the weight); backward sums make each step a
conditional probability.

Perturbed A* search, top down: the root's perturbed maximum is a Gumbel variate, and a
region's maximum is one truncated by its parent's. A region is all segmentations that share
the words before word i and differ from those found there in word i. The best region is
popped, one segmentation is drawn from it, and what is left of it and the regions along the
new path are pushed. Pops come in the order of perturbed scores, so the first k are a sample
without replacement; the score of the next region gives each sample's inclusion probability.
Scores are kept as arrival times exp(-score), in which a truncated Gumbel variate is the parent's time plus an
exponential one over the region's mass. All variates are hashes of the row key, path and
word, so a row's samples do not depend on how rows are dealt out.

Lattices, walks and searches are vectorised over half a megabyte of text at a time: equal words
share one lattice, k independent walks over all words supply the paths, and the texts' searches
draw their next paths in step.

Regions of a log mass below DEEPEST are not pushed, nor is a rest of less than 1e-12 of its region:
either could come first only with a probability below 1e-11 for each draw.

Defined results: a null text has no samples (null), an empty one has one sample without
pieces; a text with fewer than k segmentations has as many as there are; repeated rows
have equal samples; an empty table stays empty; clashing columns are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .shingles import mix
from .textstats import passes

#: Log mass below which a region cannot come first: its time would beat others only if a variate were below exp(-60).
DEEPEST = -60.0
#: Words that are looked at first for regions above DEEPEST, and words of several texts that are looked at together.
NEAR, CELLS = 128, 200_000
#: Bytes of text that are segmented at a time (a longer text is a pass of its own).
PASS_BYTES = 500_000
_WORD = 2**64 - 1


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, read by Spark, so that any store will do; its size is that of a vocabulary."""
    where = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(where).select("content").first()[0])


class Vocabulary:
    """Pieces as UTF-8 with plain blanks, their ranks' weights, and a trie as a hash table."""

    def __init__(self, model: bytes, temperature: float):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = own.vocab_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        ranked = []
        for i in range(size):
            if own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                continue
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            else:
                self.bytes[i] = piece.replace("▁", " ").encode()
                ranked.append(i)
        if any(b" " in self.bytes[i].lstrip(b" ") or b"\n" in self.bytes[i] for i in ranked):
            raise ValueError("pieces that reach over a blank or a line's end are not supported")
        total = np.log(1 / (np.arange(size) + 2.0)).max()
        self.weight = np.full(size, np.log(1 / (size + 2.0)) / temperature - total)
        self.weight[ranked] = np.log(1 / (np.arange(len(ranked)) + 2.0)) / temperature
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i in ranked:
            node = 0
            for b in self.bytes[i]:
                node = nodes.setdefault((node, b), len(nodes) + 1)
            ends.setdefault(node, i)
        self._table(nodes)
        # the first two bytes lead straight to their node (-1: to none)
        self.one, self.two = np.full(256, -1, np.int32), np.full(65536, -1, np.int32)
        for (n, b), child in nodes.items():
            if n == 0:
                self.one[b] = child
        first = {int(child): b for b, child in enumerate(self.one) if child >= 0}
        for (n, b), child in nodes.items():
            if n in first:
                self.two[first[n] * 256 + b] = child
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())


    def _table(self, nodes: dict[tuple[int, int], int]) -> None:
        """A hash table of (node, byte), with empty places after full ones."""
        bits = max(4, len(nodes).bit_length() + 2)
        self.shift = np.uint32(32 - bits)
        self.keys, self.child = np.full((1 << bits) + len(nodes), -1, np.int32), np.full((1 << bits) + len(nodes), -1, np.int32)
        keys = np.array([n * 256 + b for n, b in nodes], np.int32)
        for at, key, child in zip(self._slot(keys).tolist(), keys.tolist(), nodes.values(), strict=True):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.child[at] = key, child

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint32) * np.uint32(2654435761)) >> self.shift

    def after(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that the bytes lead to (-1: to none)."""
        key = node * np.int32(256) + byte
        at = self._slot(key)
        to, there = self.child[at], self.keys[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        to[there < 0] = -1
        while len(open_):
            at[open_] += np.uint32(1)
            there = self.keys[at[open_]]
            to[open_] = self.child[at[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return to


@lru_cache(maxsize=2)
def vocabulary(model: bytes, temperature: float) -> Vocabulary:
    return Vocabulary(model, temperature)


class Lattices:
    """The lattices of a part's distinct words as one table of steps.

    A state is a byte position; its steps lie together, longest piece first (mostly the
    likeliest), with running probabilities, so a draw is settled after a step or two. States
    are numbered by the bytes left to their word's end, so backward sums go over slices. A
    word's figures do not depend on the words that it was added with.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def load(self, data: np.ndarray, bounds: np.ndarray) -> None:
        """Sets up the lattices of words that lie one after another in data."""
        vocab = self.vocab
        n = len(data)
        end = np.repeat(bounds[1:], np.diff(bounds)).astype(np.int32)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.append(starts[1:], n)
        n_steps = np.zeros(n, np.int32)
        pos, node, far = starts.astype(np.int32), np.zeros(len(starts), np.int32), 0
        covered = np.zeros(n, bool)
        char_end = np.zeros(n, np.int32)
        char_end[starts] = after
        levels = []
        while len(pos):
            inside = pos + far < end[pos]
            if not inside.all():
                pos, node = pos[inside], node[inside]
            byte = data[pos + far]
            if far == 0:
                to = vocab.one[byte]
            elif far == 1:
                to = vocab.two[data[pos].astype(np.int32) * 256 + byte]
            else:
                to = vocab.after(node, byte)
            hit = to >= 0
            pos, node, far = pos[hit], to[hit], far + 1
            ident = vocab.piece[node]
            real = ident >= 0
            source = pos[real]
            n_steps[source] += 1
            covered[source[char_end[source] == source + far]] = True
            levels.append((source, far, ident[real]))
        bare = np.flatnonzero(~np.repeat(covered[starts], after - starts)).astype(np.int32)
        n_steps[bare] += 1
        levels.insert(0, (bare, 1, vocab.byte_id[data[bare]]))
        states = np.flatnonzero(n_steps)
        left = end[states] - states
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 65536 else left, kind="stable")
        states, left = states[order], left[order]
        count = n_steps[states]
        bound = np.concatenate([[0], np.cumsum(count)])
        number = np.full(n + 1, -1, np.int32)
        number[states] = np.arange(len(states))
        free = np.zeros(n, np.int32)
        free[states] = bound[:-1]
        nxt, ids = np.empty(bound[-1], np.int32), np.empty(bound[-1], np.int32)
        for source, far, ident in reversed(levels):
            at = free[source]
            free[source] = at + 1
            target = source + np.int32(far)
            nxt[at] = np.where(target == end[source], -1, number[target])
            ids[at] = ident
        del levels
        weight = vocab.weight[ids]
        back = np.zeros(len(states) + 1)  # the last one is the words' end
        cuts = np.flatnonzero(np.diff(left, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(states)).tolist(), strict=True):
            own = slice(bound[a], bound[b])
            weight[own] += back[nxt[own]]
            back[a:b] = np.logaddexp.reduceat(weight[own], bound[a:b] - bound[a])
        logp = np.minimum(weight - np.repeat(back[:-1], count), 0.0)
        first = bound[:-1].astype(np.int32)
        logp[first[count == 1]] = 0.0
        upto = np.exp(logp)
        several, far = np.flatnonzero(count > 1), 1
        while len(several):
            at = first[several] + far
            upto[at] += upto[at - 1]
            far += 1
            several = several[count[several] > far]
        upto[bound[1:] - 1] = 2.0
        self.logp, self.upto, self.next, self.ids = logp, upto, nxt, ids
        self.first, self.n_steps, self.start = first, count, number[bounds[:-1]]

    def walk(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One draw for each word: log probability, and its steps one after another with their bounds."""
        logp, state, active = np.zeros(len(words)), self.start[words], np.arange(len(words), dtype=np.int32)
        counts, taken = np.zeros(len(words), np.int32), []
        while len(active):
            u = uniform(keys + np.uint64(len(taken)) * np.uint64(0xD1342543DE82EF95))
            step = self.first[state]
            open_ = np.flatnonzero(u >= self.upto[step])
            while len(open_):
                step[open_] += 1
                open_ = open_[u[open_] >= self.upto[step[open_]]]
            taken.append((active, step))
            logp[active] += self.logp[step]
            state = self.next[step]
            more = state >= 0
            counts[active[~more]] = len(taken)
            active, state, keys = active[more], state[more], keys[more]
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        steps = np.empty(bounds[-1], np.int32)
        for i, (who, step) in enumerate(taken):
            steps[bounds[who] + i] = step
        return logp, steps, bounds

    def other(self, word: int, found: list[tuple[int, ...]], draws: Iterator[float]) -> tuple[int, ...]:
        """A draw from a word's segmentations without those found, by their probabilities."""
        state, out, exp = int(self.start[word]), [], math.exp
        rest = []
        for f in found:
            tails, total = [], 0.0
            for own in reversed(self.logp[list(f)].tolist()):
                total += own
                tails.append(total)
            rest.append((f, tails[::-1]))  # the steps, and the log probability of those from each one on
        while state >= 0:
            a, depth = int(self.first[state]), len(out)
            mass = [exp(x) for x in self.logp[a : a + int(self.n_steps[state])].tolist()]
            for f, tails in rest:
                s = f[depth] - a
                mass[s] = 0.0 if len(f) == depth + 1 else max(mass[s] - exp(tails[depth]), 0.0)
            total = sum(mass)
            if total <= 0:  # all but rounding errors is found
                return ()
            u, chosen = next(draws) * total, -1
            for s, m in enumerate(mass):
                if m > 0:
                    chosen = s
                    if u < m:
                        break
                    u -= m
            chosen += a
            out.append(chosen)
            rest = [x for x in rest if x[0][depth] == chosen]
            state = int(self.next[chosen])
        return tuple(out)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that the keys determine."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / float(2**53)


def word_bounds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units start: each text, each run of blanks (with the word after it), each line's end and what follows it."""
    blank, line = data == 32, data == 10
    start = line.copy()
    start[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
    start[at[:-1]] = True
    return np.flatnonzero(start)


class Path:
    """A sample: its number (and walk), its time, its first own word and the log mass before that, and its parts.

    parts: ("walk", r, from word, to word) and ("steps", steps) that make up the path.
    """

    __slots__ = ("number", "time", "first", "before", "logp", "parts")

    def __init__(self, number: int, time: float, first: int, before: float, logp: float, parts: list):
        self.number, self.time, self.first, self.before, self.logp, self.parts = number, time, first, before, logp, parts


class Searches:
    """The searches of a part's texts, in step: each round draws one more path for every text.

    walks: (log probabilities, steps, bounds) over all words; span: the texts' first words.
    """

    def __init__(self, k: int, keys: np.ndarray, span: np.ndarray, words: np.ndarray, walks: list, lattices: Lattices):
        self.k, self.keys, self.span, self.words, self.walks, self.lattices = k, keys, span, words, walks, lattices
        n = len(keys)
        self.heaps, self.found, self.order = [[] for _ in range(n)], [[] for _ in range(n)], 0
        self.draws = [_draws(key) for key in keys.tolist()]

    def run(self) -> None:
        size = np.diff(self.span)
        texts = np.flatnonzero(size).tolist()
        logps = np.add.reduceat(self.walks[0][0], self.span[:-1][size > 0]).tolist() if texts else []
        for d, logp in zip(texts, logps, strict=True):
            self.found[d].append(Path(0, -math.log(next(self.draws[d])), 0, 0.0, logp, [("walk", 0, 0, int(size[d]))]))
        self.push(texts)
        for r in range(1, self.k):
            grown = [d for d in texts if len(self.found[d]) == r and self.draw(d)]
            self.push(grown)

    def draw(self, d: int) -> bool:
        """Pops regions until one yields a path; False if none is left."""
        heap, found, rng, a, b = self.heaps[d], self.found[d], self.draws[d], int(self.span[d]), int(self.span[d + 1])
        while heap:
            time, _, path, i, mass, before, known = heapq.heappop(heap)
            if known is None:
                _, steps, edge = self.walks[path.number]
                known = [tuple(steps[edge[a + i] : edge[a + i + 1]].tolist())]
            drawn = self.lattices.other(int(self.words[a + i]), known, rng)
            if not drawn:
                continue
            r = len(found)
            upto = before + float(self.lattices.logp[list(drawn)].sum())
            parts = _until(path.parts, i) + [("steps", drawn)] + ([("walk", r, i + 1, b - a)] if i + 1 < b - a else [])
            found.append(Path(r, time, i + 1, upto, upto + float(self.walks[r][0][a + i + 1 : b].sum()), parts))
            left = mass - math.exp(upto)
            if left > 1e-12 * mass:
                self.order += 1
                heapq.heappush(heap, (time - math.log(next(rng)) / left, self.order, path, i, left, before, [*known, drawn]))
            return True
        return False

    def push(self, texts: list[int]) -> None:
        """Regions that leave the texts' newest paths."""
        left, near = np.array(texts, np.int64), NEAR
        while len(left):  # where most words have one likely segmentation, more words are looked at
            left = np.concatenate([self._push(some, near) for some in np.array_split(left, 1 + len(left) * near // CELLS)])
            near *= 4

    def _push(self, texts: np.ndarray, near: int) -> np.ndarray:
        """Looks at the next `near` words of each text; the texts of which more has to be looked at."""
        if not len(texts):
            return texts
        paths = [self.found[d][-1] for d in texts.tolist()]
        r, k = paths[0].number, self.k
        first, before, time = (np.array([getattr(p, x) for p in paths]) for x in ("first", "before", "time"))
        at = self.span[texts] + first
        n = self.span[texts + 1] - at
        word = np.arange(min(near, int(n.max())))
        there = word < n[:, None]
        own = np.where(there, self.walks[r][0][np.minimum(at[:, None] + word, len(self.words) - 1)], 0.0)
        upto = before[:, None] + np.cumsum(own, axis=1)
        deeper = (n > near) & (upto[:, -1:] > DEEPEST).any(1)
        some = ~deeper
        prior = np.concatenate([before[:, None], upto[:, :-1]], 1)
        looked = there & (prior > DEEPEST) & some[:, None]
        row, col = np.nonzero(looked)
        prior, own = prior[row, col], own[row, col]
        mass = np.exp(prior) * (0.0 - np.expm1(own))
        keys = self.keys[texts[row]] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1) + (first[row] + col).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        with np.errstate(divide="ignore"):
            times = time[row] - np.log(uniform(keys)) / mass
        open_ = np.flatnonzero(mass > 0)
        best = open_[np.lexsort((col[open_], times[open_], row[open_]))]
        rank = np.arange(len(best)) - np.searchsorted(row[best], row[best])
        best = best[rank <= k]
        for j, t, w, m, x in zip(row[best].tolist(), times[best].tolist(), (first[row[best]] + col[best]).tolist(), mass[best].tolist(), prior[best].tolist(), strict=True):
            self.order += 1
            heapq.heappush(self.heaps[texts[j]], (t, self.order, paths[j], w, m, x, None))
        return texts[deeper]


def _until(parts: list, word: int) -> list:
    """The parts of a path before a word."""
    out, at = [], 0
    for part in parts:
        size = 1 if part[0] == "steps" else part[3] - part[2]
        if at + size <= word:
            out.append(part)
        elif at < word:
            out.append(("walk", part[1], part[2], part[2] + word - at))
        at += size
    return out


def _draws(key: int) -> Iterator[float]:
    i = 0
    while True:
        x = (key ^ 0x94D049BB133111EB) + i * 0x2545F4914F6CDD1D & _WORD
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
        yield ((x ^ x >> 31) >> 11) / 2**53 + 2.0**-54
        i += 1


def samples_of(texts: pa.Array, keys: np.ndarray, k: int, lattices: Lattices) -> Iterator[tuple[int, list[list[tuple[np.ndarray, float, float, float]]]]]:
    """(first row, samples of consecutive rows); a sample is ids, log probability, perturbed score, log inclusion probability."""
    nothing = (np.zeros(0, np.int32), 0.0, 0.0, 0.0)
    with np.errstate(over="ignore"):
        for row, n, raw, at in passes(texts, PASS_BYTES):
            size = np.diff(at)
            if not size.any():
                yield row, [[nothing] for _ in range(n)]
                continue
            shift = np.cumsum(size > 0) - (size > 0)
            data = np.insert(raw, at[:-1][size > 0], 32)  # the blank before a text's first word
            own = np.concatenate([at[:-1] + shift, [len(data)]])
            full = np.flatnonzero(size > 0)
            starts = word_bounds(data, np.append(own[:-1][full], len(data)))
            units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            _, bounds, body = units.dictionary.buffers()
            bounds = np.frombuffer(bounds, np.int64)[: len(units.dictionary) + 1]
            lattices.load(np.frombuffer(body, np.uint8)[: bounds[-1]], bounds)
            words = np.asarray(units.indices)
            doc = full[np.searchsorted(own[:-1][full], starts, "right") - 1]
            span = np.searchsorted(doc, np.arange(n + 1))
            place = (np.arange(len(words)) - span[doc]).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
            base = mix(keys[row : row + n])
            walks = [lattices.walk(words, mix(base[doc] + np.uint64(0xE7037ED1A0B428DB) * np.uint64(r + 1)) + place) for r in range(k)]
            found = Searches(k, base, span, words, walks, lattices)
            found.run()
            ids = [lattices.ids[steps] for _, steps, _ in walks]
            out = []
            for paths, heap, a in zip(found.found, found.heaps, span.tolist(), strict=False):
                then = math.log(heap[0][0]) if heap else math.inf
                rows = []
                for path in paths:
                    drawn = [lattices.ids[list(p[1])] if p[0] == "steps" else ids[p[1]][walks[p[1]][2][a + p[2]] : walks[p[1]][2][a + p[3]]] for p in path.parts]
                    x = path.logp + then
                    rows.append((np.concatenate(drawn), path.logp, -math.log(path.time), x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))))
                out.append(rows or [nothing])
            yield row, out


_SAMPLE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("logp", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])


def text_of(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text that ids spell, without the blank before its first word."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def _sampled(batches: Iterator[pa.RecordBatch], text_at: int, k: int, temperature: float, model, decode: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model.value, temperature)
    lattices = Lattices(vocab)
    for batch in batches:
        texts = batch.column(text_at)
        keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for row, found in samples_of(texts, keys, k, lattices):
            known = np.asarray(texts.slice(row, len(found)).is_valid())
            flat = [x for samples, ok in zip(found, known, strict=True) if ok for x in samples]
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *[x[0] for x in flat]]), pa.int32()))
            each = pa.StructArray.from_arrays([ids, *[pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]], _SAMPLE.names)
            counts = np.where(known, [len(x) for x in found], 0)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=None), each, mask=pa.array(~known))
            rest = batch.slice(row, len(found))
            more, names = [column], ["samples"]
            if decode:
                more.append(pa.array([text_of(samples[0][0], vocab) if ok else None for samples, ok in zip(found, known, strict=True)], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], *more], names=[*batch.schema.names[:-1], *names])


def sampled(docs: DataFrame, model_path: str, k: int = 3, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, decode: bool = False) -> DataFrame:
    """docs with `samples`: at most k distinct segmentations of each text, best perturbed score first.

    decode: adds `decoded`, the best sample's ids as text again, in the same pass over the rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model_bytes(spark, model_path))
    new = [T.StructField("samples", T.ArrayType(_SAMPLE))] + ([T.StructField("decoded", T.StringType())] if decode else [])
    had = [c for c in docs.columns if c.lower() not in [f.name for f in new]]
    keyed = docs.select(*[F.col(f"`{c}`") for c in had], F.xxhash64(F.lit(seed), F.col(id_col)).alias(fresh(docs, "_key")[0]))
    schema = T.StructType([*[f for f in docs.schema if f.name in had], *new])
    return keyed.mapInArrow(partial(_sampled, text_at=had.index(text_col), k=k, temperature=temperature, model=model, decode=decode), schema)


def decoder(spark: SparkSession, model_path: str):
    """A column function from ids to text; ids that name no piece of text decode to nothing."""
    model = spark.sparkContext.broadcast(model_bytes(spark, model_path))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        vocab = vocabulary(model.value, 1.0)
        bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        out = []
        for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.asarray(ids.is_valid()).tolist(), strict=True):
            out.append(text_of(flat[a:b], vocab) if ok else None)
        return pa.array(out, pa.string())

    return decode


def decoded(df: DataFrame, ids: Column, model_path: str, name: str = "decoded") -> DataFrame:
    return df.withColumn(name, decoder(df.sparkSession, model_path)(ids))
