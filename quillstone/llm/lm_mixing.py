"""LM scoring by online logistic context mixing over the bits of words, beside an add-one unigram base."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, drop_cut, fold, load
from quillstone.llm.packing import groups

#: (bytes of context inside the word, address bits, whether the text's class is part of the context) of the hashed predictors.
ORDERS = ((2, 19, True), (3, 19, False), (5, 20, False))
BACK = max(order for order, *_ in ORDERS)
FIRST = np.concatenate(([0], np.cumsum([1 << b for _, b, _ in ORDERS])))
SLOTS = int(FIRST[-1])
#: Predictors: the hashed ones and the whole word so far, of up to DEPTH bytes, whose counts are exact and grow with the vocabulary.
INPUTS, DEPTH = len(ORDERS) + 1, 64
PRIME = 0x9E3779B97F4A7C15
LEVELS, GRID, SPAN, LEAST = 6, 33, 12.0, 1e-6
GATES = LEVELS * LEVELS


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words and one end (the empty token)."""
    return [*(text or b"").lower().split(), b""]


def joined(words: pa.Array) -> np.ndarray:
    """The bytes of words, each ended by a space."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return np.append(np.frombuffer(pc.binary_join(whole, b" ")[0].as_buffer(), np.uint8), np.uint8(32))


class Spelled:
    """Words one after the other, each ended by a space: bytes, their place in the word, their class, and where words start."""

    def __init__(self, words: pa.Array | list[bytes], classes: np.ndarray):
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        self.data = joined(words)
        lens = pc.binary_length(words).to_numpy().astype(np.int64) + 1
        self.starts = np.cumsum(lens) - lens
        self.lens = lens
        self.place = (np.arange(len(self.data)) - np.repeat(self.starts, lens)).astype(np.int32)
        self.classes = np.repeat(classes.astype(np.uint8) + np.uint8(1), lens)

    def bits(self, first: int, end: int, some: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the 8 bits of (some of) the bytes from first to end: the bits, and their slots in the hashed predictors' tables."""
        at = max(0, first - BACK)
        data, place = self.data[at:end].astype(np.uint64), self.place[at:end]
        contexts = []
        for k, (order, _, classed) in enumerate(ORDERS):
            held = np.zeros(len(data), np.uint64)
            for j in range(1, order + 1):
                earlier = np.zeros(len(data), np.uint64)
                earlier[j:] = data[:-j] if j < len(data) else 0
                held |= np.where(place >= j, earlier + np.uint64(1), 0).astype(np.uint64) << np.uint64(9 * (j - 1))
            held = held[first - at :] + np.uint64(k + 1)
            contexts.append(((held ^ (self.classes[first:end].astype(np.uint64) << np.uint64(56)) if classed else held) * np.uint64(PRIME))[some])
        data, own = data[first - at :][some], self.data[first:end][some]
        for b in range(8):
            node = (np.uint64(1 << b) | (data >> np.uint64(8 - b))) if b else np.ones(len(data), np.uint64)
            slots = np.empty((len(ORDERS), len(data)), np.int64)
            for k, (_, bits, _) in enumerate(ORDERS):
                mixed = (contexts[k] ^ (node * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(PRIME)
                mixed ^= mixed >> np.uint64(32)
                slots[k] = ((mixed * np.uint64(PRIME)) >> np.uint64(64 - bits)).astype(np.int64) + FIRST[k]
            yield (own >> (7 - b)) & 1, slots

    def windows(self, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
        for first in range(0, len(self.data), size):
            yield first, min(first + size, len(self.data))


class Prefixes:
    """Counts of the next bit after the whole word so far, among sorted words; words that share no more bits stand alone.

    ``source`` gives, for each byte, the first one that follows the same bytes and is the same: what is predicted
    of a byte depends on the word so far, so it need not be worked out again for words that begin alike.

    ``heads`` gives, for a word's group (words of a class with the same first bytes), the counts of all words along
    those first bytes; deeper ones are counted in the group, which is here whole.
    """

    def __init__(self, text: Spelled, words: pa.Array | list[bytes], own: np.ndarray, group: np.ndarray, heads: list[np.ndarray]):
        kept = np.minimum(text.lens, DEPTH)
        self.starts = np.cumsum(kept) - kept
        self.counts = np.zeros((2, 8, int(kept.sum()) + 1), np.float32)  # the last place is for bytes beyond DEPTH
        self.where = np.where(text.place < DEPTH, np.repeat(self.starts, text.lens) + text.place, self.counts.shape[2] - 1)
        shared = self.shared_bits(text, kept, group)
        known = np.array([h.shape[1] // 8 for h in heads], np.int64)
        paths = np.zeros((len(heads), 2, 8 * int(known.max(initial=0))), np.float32)
        for g, h in enumerate(heads):
            paths[g, :, : h.shape[1]] = h
        known, self.source = known[group], np.arange(len(text.data))
        for j in range(int(kept.max(initial=0))):
            some = np.flatnonzero(kept > j)
            fresh = np.flatnonzero(shared[some] < 8 * j + 8)  # the others have the byte of the word before them
            first = some[fresh]
            if len(first) < len(some):
                self.source[text.starts[some] + j] = np.repeat(text.starts[first] + j, np.diff(np.append(fresh, len(some))))
            byte = text.data[text.starts[first] + j]
            at, weight = self.starts[first] + j, np.add.reduceat(own[some], fresh)
            for b in range(8):
                bit = (byte >> (7 - b)) & 1
                new = shared[first] < 8 * j + b
                if new.all():
                    zeros, ones = weight * (bit == 0), weight * bit
                else:
                    segment = np.cumsum(new) - 1
                    ones = np.bincount(segment, weight * bit)[segment]
                    zeros = np.bincount(segment, weight)[segment] - ones
                self.counts[0, b, at], self.counts[1, b, at] = zeros, ones
            head = np.flatnonzero(known[first] > j)
            if len(head):
                self.counts[:, :, at[head]] = paths[group[first[head]], :, 8 * j : 8 * j + 8].transpose(1, 2, 0)
        self.where = self.where[self.source]

    @staticmethod
    def shared_bits(text: Spelled, kept: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Bits that each word shares with the one before it, -1 for the first of a group."""
        shared = np.where(np.append(True, group[1:] != group[:-1]), -1, 0)
        alive, j = np.flatnonzero(shared == 0), 0
        while len(alive):
            alive = alive[(kept[alive] > j) & (kept[alive - 1] > j)]
            differ = text.data[text.starts[alive] + j] ^ text.data[text.starts[alive - 1] + j]
            same = differ == 0
            shared[alive] += np.where(same, 8, 8 - np.frexp(differ.astype(np.float64))[1])
            alive, j = alive[same], j + 1
        return shared

    def of(self, b: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at(b, np.arange(first, end))

    def at(self, b: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.where[some]
        return self.counts[0, b].take(at), self.counts[1, b].take(at)


def level(n: np.ndarray) -> np.ndarray:
    """Confidence of a count: 0, 1, 2 to 3, 4 to 15, 16 to 255, more."""
    out = np.zeros(n.shape, np.int8)
    for least in (1, 2, 4, 16, 256):
        out += n >= least
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Gated weights over the predictors' stretched probabilities, then a table that refines the mix by gate and stretch."""

    weights: np.ndarray
    refine: np.ndarray

    @staticmethod
    def new() -> Mixer:
        w = np.zeros((GATES, INPUTS + 1))
        w[:, :-1], w[GATES - LEVELS :, -2] = 0.3, 0.7
        return Mixer(w, np.tile(squash(np.linspace(-SPAN, SPAN, GRID)), (GATES, 1)))

    def mix(self, inputs: list[np.ndarray] | np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Final and mixed probability of a 1, and the place in the refining table with its share."""
        weights, flat = self.weights.T.astype(np.float32), self.refine.ravel().astype(np.float32)
        dot = weights[-1].take(gate)
        for k in range(INPUTS):
            dot += weights[k].take(gate) * inputs[k]
        dot = np.clip(dot, np.float32(-SPAN + 1e-3), np.float32(SPAN - 1e-3))
        mixed, at = squash(dot), (dot + np.float32(SPAN)) * np.float32((GRID - 1) / (2 * SPAN))
        low = at.astype(np.int32)
        share, cell = at - low, gate * np.int32(GRID) + low
        refined = flat.take(cell) * (1 - share) + flat.take(cell + 1) * share
        return np.clip((mixed + refined) * np.float32(0.5), LEAST, 1 - LEAST), mixed, low + (share >= 0.5), share

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
        """One online step over a small batch of bits; the mass by cell of the refining table."""
        _, mixed, near, _ = self.mix(inputs, gate)
        error, mass = (bit - mixed) * weight, np.bincount(gate, weight, GATES)
        for k in range(INPUTS + 1):
            x = inputs[k] if k < INPUTS else 1.0
            self.weights[:, k] += rate * np.divide(np.bincount(gate, error * x, GATES), mass, out=np.zeros(GATES), where=mass > 0)
        cell = gate * GRID + near
        got = np.bincount(cell, weight, GATES * GRID)
        ones = np.bincount(cell, weight * bit, GATES * GRID)
        flat = self.refine.ravel()
        seen = got > 0
        step = got[seen] / (got[seen] + 20)
        flat[seen] += 0.5 * step * (ones[seen] / got[seen] - flat[seen])
        return got.reshape(GATES, GRID)


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.05)) / (zeros + np.float32(0.05)))


@dataclass
class Model:
    """Counts of the hashed predictors, and the mixer of all predictors."""

    zeros: np.ndarray
    ones: np.ndarray
    mixer: Mixer

    @staticmethod
    def new() -> Model:
        return Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), Mixer.new())

    def prepare(self) -> Model:
        self.stretch, self.levels = stretched(self.zeros, self.ones), level(self.zeros[FIRST[-2] :] + self.ones[FIRST[-2] :])
        return self

    def costs(self, text: Spelled, prefixes: Prefixes) -> np.ndarray:
        """log10 of the probability of each word with its end."""
        total = np.ones(len(text.data))  # the probability of each byte: 8 factors of 1e-6 or more
        for first, end in text.windows():
            some = first + np.flatnonzero(prefixes.source[first:end] == np.arange(first, end))
            p_of = np.ones(len(some))
            for b, (bit, slots) in enumerate(text.bits(first, end, some - first)):
                whole = prefixes.at(b, some)
                gate = level(whole[0] + whole[1]).astype(np.int64) * LEVELS + self.levels.take(slots[-1] - FIRST[-2])
                p, *_ = self.mixer.mix([*self.stretch.take(slots), stretched(*whole)], gate)
                p_of *= np.where(bit == 1, p, 1 - p)
            total[some] = p_of
        return np.add.reduceat(np.log10(total).take(prefixes.source), text.starts)

    def learn(self, text: Spelled, prefixes: Prefixes, own: np.ndarray, rate: float) -> np.ndarray:
        """Online steps of the mixer over the words, each bit predicted from counts less the one occurrence it is; their mass by cell of the refining table.

        Bytes of a window that have the same source are predicted alike, and so taken once, as often as they stand.
        """
        mass = np.zeros((GATES, GRID))
        n = np.repeat(own, text.lens).astype(np.float64)
        for first, end in text.windows(1 << 13):
            _, once, same = np.unique(prefixes.source[first:end], return_index=True, return_inverse=True)
            times = np.bincount(same, n[first:end])
            for b, (bit, slots) in enumerate(text.bits(first, end, once)):
                whole = prefixes.at(b, first + once)
                one = np.vstack([self.zeros.take(slots), whole[0]]) - (bit == 0)
                two = np.vstack([self.ones.take(slots), whole[1]]) - (bit == 1)
                one, two = np.maximum(one, 0), np.maximum(two, 0)
                gate = level(one[-1] + two[-1]).astype(np.int64) * LEVELS + level(one[-2] + two[-2])
                mass += self.mixer.learn(stretched(one, two), gate, bit.astype(np.float64), times, rate)
        return mass


#: crc32 of each byte, by which words' crc32 are worked out side by side.
CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 64) -> np.ndarray:
    """crc32 of each word, a byte of all words at a time; of words over ``most`` bytes one by one."""
    order = np.argsort(-sizes)
    order = order[np.searchsorted(-sizes[order], -most) :]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    ends = np.searchsorted(-sizes[order], -np.arange(1, most + 1), side="right")
    for j, n in enumerate(ends[ends > 0].tolist()):
        crc[:n] = CRC.take((crc[:n] ^ data.take(at[:n] + j)) & 0xFF) ^ (crc[:n] >> 8)
    out = np.empty(len(sizes), np.int64)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > most).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


def as_strings(texts: pa.Array) -> pa.Array:
    """Binary values as strings whose bytes nobody checks, so that Arrow's ASCII functions take them."""
    return pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)


class Indexed:
    """Some texts' words as numbers: ids into their distinct words, and where each text starts."""

    def __init__(self, words: list[list[bytes]]):
        self.number(np.array([len(w) for w in words], np.int64), pa.array(chain.from_iterable(words), pa.binary()))

    @classmethod
    def of(cls, texts: pa.Array) -> Indexed:
        """The tokens() of binary texts, worked out by Arrow."""
        held = pc.ascii_trim_whitespace(pc.ascii_lower(as_strings(pc.fill_null(texts, b""))))
        # what follows the space put behind the last word is the end; a text without words is its end
        split = pc.ascii_split_whitespace(pc.binary_join_element_wise(held, pc.if_else(pc.equal(pc.binary_length(held), 0), "", " "), ""))
        out = cls.__new__(cls)
        out.number(pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten())
        return out

    def number(self, lens: np.ndarray, words: pa.Array) -> None:
        self.lens, self.starts = lens, np.cumsum(lens) - lens
        found = words.dictionary_encode()
        self.ids = found.indices.to_numpy().astype(np.int64)
        _, offsets, data = found.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(found.dictionary) + 1].astype(np.int64)
        self.sizes = np.diff(ends)
        self.crc = crcs(np.frombuffer(data or b"", np.uint8), ends[:-1], self.sizes)
        self.array = pa.Array.from_buffers(pa.binary(), len(found.dictionary), found.dictionary.buffers(), offset=found.dictionary.offset)

    @cached_property
    def distinct(self) -> list[bytes]:
        # words hold no space
        return joined(self.array).tobytes()[:-1].split(b" ") if len(self.sizes) else []


#: The level of every count up to 256, where levels end.
LEVEL_OF = level(np.arange(257)).astype(np.int64)


def in_order(key: np.ndarray) -> np.ndarray:
    """Places of the keys (not negative) in their order, equal ones as they stand; sorted as one number with the place where 63 bits hold both."""
    n = len(key)
    shift = max(1, n).bit_length()
    if n and int(key.max()).bit_length() + shift > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << shift) | np.arange(n)) & ((1 << shift) - 1)


class Followers:
    """For each word of some texts: the word that followed when the two words (or the one) before it stood last in the same text."""

    def __init__(self, words: Indexed):
        ids, lens = words.ids, words.lens
        marks, sizes = words.crc & (HASHED - 1), np.minimum(words.sizes, 15) // 2
        n, many, places = len(ids), len(words.sizes) + 1, np.arange(len(ids))
        at = places - np.repeat(words.starts, lens)
        back = [np.concatenate((np.full(j, -1), ids[:-j]))[:n] if n else ids for j in (1, 2)]
        one, two = np.where(at >= 1, back[0] + 1, 0), np.where(at >= 2, back[1] + 1, 0)
        self.before, self.next, self.hits, earlier, seen, runs, key = [], [], [], [], [], [], np.repeat(np.arange(len(lens)), lens) * many + one
        for context in (None, two):
            if context is not None:  # within the places of one word before in a text
                key = group * many + context
            sort = in_order(key)
            held = key[sort]
            same = np.append(False, held[1:] == held[:-1])[:n]
            start = np.maximum.accumulate(np.where(same, 0, places)) if n else sort
            group, before, rank = np.empty(n, np.int64), np.full(n, -1), np.empty(n, np.int64)
            group[sort], rank[sort] = start, places - start
            before[sort[same]] = sort[np.flatnonzero(same) - 1]
            some = before >= 0
            follows = np.where(some, ids[before], -1)
            hit = some & (follows == ids)
            miss = np.maximum.accumulate(np.where(hit, -1, places)) if n else before
            run = np.minimum(np.append(0, (places - miss)[:-1]), at)[:n]
            for held, x in zip((self.before, self.next, self.hits, earlier, seen, runs), (some, follows, hit, before, rank, run), strict=True):
                held.insert(0, x)
        two_asked = self.before[0]
        one_asked = self.before[1] & ~self.hits[0] & ~(two_asked & (self.next[0] == self.next[1]))
        self.contexts = []
        for order, asked in enumerate((two_asked, one_asked)):
            some = np.flatnonzero(asked)
            gate = order * LEVELS + LEVEL_OF[np.minimum(runs[order][some], 16)]
            last = self.hits[order][earlier[order][some]] + 1
            known = (order * LEVELS + LEVEL_OF[np.minimum(seen[order][some], 256)]) * 8 + sizes[self.next[order][some]]
            word = order * HASHED + np.where(at[some] >= 1, marks[back[0][some]], 0)
            self.contexts.append((some, (gate, gate * 3 + last, known, word)))
        self.asked, self.hits = (two_asked, one_asked), (self.hits[0], one_asked & self.hits[1])

    def questions(self) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]]:
        """For two words and one: where the question is asked, its contexts there, and the answers."""
        for (some, contexts), hit in zip(self.contexts, self.hits, strict=True):
            yield some, contexts, hit[some]


#: Slots of the hashed word before, of each of the two orders.
HASHED = 4096


class Repeats:
    """Probability that a follower comes again: three context tables, mixed by weights for each order and run of hits, learned as texts are read."""

    SIZES = (2 * LEVELS * 3, 2 * LEVELS * 8, 2 * HASHED)

    def __init__(self) -> None:
        self.tables = [np.tile([[0.4], [0.1]], n) for n in self.SIZES]
        self.weights = np.full((2 * LEVELS, len(self.SIZES) + 1), 0.4)
        self.weights[:, -1] = 0

    def inputs(self, contexts: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        return [np.log((t[1] / t[0]).take(c)) for t, c in zip(self.tables, contexts[1:], strict=True)] + [np.ones(len(contexts[0]))]

    def probability(self, contexts: tuple[np.ndarray, ...], inputs: list[np.ndarray] | None = None) -> np.ndarray:
        inputs = self.inputs(contexts) if inputs is None else inputs
        dot = sum(self.weights[:, k].take(contexts[0]) * x for k, x in enumerate(inputs))
        return np.clip(squash(dot), LEAST, 1 - LEAST)

    def learn(self, contexts: tuple[np.ndarray, ...], hit: np.ndarray, rate: float = 0.05) -> None:
        inputs = self.inputs(contexts)
        error, gates = hit - self.probability(contexts, inputs), len(self.weights)
        mass = np.bincount(contexts[0], minlength=gates)
        for k, x in enumerate(inputs):
            self.weights[:, k] += rate * np.divide(np.bincount(contexts[0], error * x, gates), mass, out=np.zeros(gates), where=mass > 0)
        for t, c in zip(self.tables, contexts[1:], strict=True):
            t[1] += np.bincount(c, hit, t.shape[1])
            t[0] += np.bincount(c, ~hit, t.shape[1])


def dealt(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(shard, its next ``rows`` rows or the rest of it) from batches in the order of shards; where batches end makes no difference."""
    held, n, now = [], 0, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if n and at < end and shards[at] != now:
                yield now, pa.Table.from_batches(held)
                held, n = [], 0
            while at < end:
                now, taken = int(shards[at]), min(end - at, rows - n)
                held.append(batch.slice(at, taken))
                at, n = at + taken, n + taken
                if n == rows:
                    yield now, pa.Table.from_batches(held)
                    held, n = [], 0
    if n:
        yield now, pa.Table.from_batches(held)


def together(pieces: Iterator[tuple[int, pa.Table]], size: int = 1 << 18) -> Iterator[list[pa.Table]]:
    """Tables that follow each other, about ``size`` bytes of text of them at a time."""
    held = []
    for _, table in pieces:
        held.append(table)
        if sum(t.nbytes for t in held) >= size:
            yield held
            held = []
    if held:
        yield held


def averaged(parts: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray) -> np.ndarray:
    """The mean of arrays by their masses, ``start`` where none has a mass."""
    mass = sum((m for _, m in parts), np.zeros(start.shape))
    return np.where(mass > 0, sum((x * m for x, m in parts), np.zeros(start.shape)) / np.maximum(mass, 1e-300), start)


def learn_repeats(docs: DataFrame, per_shard: int = 3000) -> Repeats:
    """docs(doc_id, text, held_out): learned from all texts that are not held out.

    Texts are dealt by their hash into shards of about ``per_shard`` texts. A shard is
    read online, in a fixed order; the counts of all shards are added up and the weights
    are averaged by the questions that they were learned from. So no text is left out,
    nothing depends on how the table is split, and shards are read side by side.
    """
    known = docs.where("not held_out and text is not null")
    shards = max(1, known.count() // per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, sum(Repeats.SIZES)), np.int64)
        weights: list[tuple[int, list[float]]] = []
        for shard, pieces in groupby(dealt(batches, 16), key=itemgetter(0)):
            out, mass = Repeats(), np.zeros(2 * LEVELS)
            for tables in together(pieces):
                words = Indexed.of(pa.concat_tables(tables).column("text").combine_chunks())
                ends = np.append(words.starts, len(words.ids))[np.cumsum([0] + [t.num_rows for t in tables])]
                asked = list(Followers(words).questions())
                for at, end in zip(ends, ends[1:], strict=False):
                    for some, contexts, hit in asked:
                        part = slice(*np.searchsorted(some, (at, end)))
                        if part.stop > part.start:
                            now = tuple(c[part] for c in contexts)
                            out.learn(now, hit[part])
                            mass += np.bincount(now[0], minlength=len(mass))
            total += np.rint(np.concatenate(out.tables, axis=1) - np.concatenate(Repeats().tables, axis=1)).astype(np.int64)
            weights.append((shard, [*out.weights.ravel().tolist(), *mass.tolist()]))
        cells = np.flatnonzero(total.any(axis=0))
        none, empty = [None] * len(weights), [None] * len(cells)
        columns = [[s for s, _ in weights] + empty, none + cells.tolist(), *(none + t[cells].tolist() for t in total), [w for _, w in weights] + empty]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "cell", "misses", "hits", "weights"])

    hashed = F.xxhash64("doc_id", "text")  # not the text alone: copies are dealt out
    part = known.select(F.pmod(hashed, F.lit(shards)).alias("shard"), hashed.alias("h"), "text").repartition("shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
    found = part.mapInArrow(run, "shard bigint, cell int, misses bigint, hits bigint, weights array<double>").groupBy("shard", "cell").agg(F.sum("misses").alias("misses"), F.sum("hits").alias("hits"), F.max("weights").alias("weights")).collect()
    out, total, parts = Repeats(), np.zeros((2, sum(Repeats.SIZES))), []
    for r in sorted((r for r in found if r["cell"] is None), key=itemgetter("shard")):
        x, mass = np.array(r["weights"][: out.weights.size]).reshape(out.weights.shape), np.array(r["weights"][out.weights.size :])
        parts.append((x, np.repeat(mass[:, None], x.shape[1], axis=1)))
    for r in found:
        if r["cell"] is not None:
            total[:, r["cell"]] = r["misses"], r["hits"]
    out.weights = averaged(parts, out.weights)
    out.tables = [t + c for t, c in zip(out.tables, np.split(total, np.cumsum(Repeats.SIZES)[:-1], axis=1), strict=True)]
    return out


#: Slots of the hashed words that tell classes.
BUCKETS = 1 << 15


def buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in words), np.int64, len(words))


@dataclass
class Classes:
    """Classes of texts (the more frequent languages) told apart by all their words, in hashed buckets."""

    logs: np.ndarray  # (buckets, classes)
    priors: np.ndarray

    def of(self, texts: Indexed) -> list[int]:
        """The class of each text."""
        if len(self.priors) == 1 or not len(texts.lens):
            return [0] * len(texts.lens)
        rows = (texts.crc & (BUCKETS - 1))[texts.ids]
        sums = [np.add.reduceat(log.take(rows), texts.starts) for log in np.ascontiguousarray(self.logs.T)]
        return (np.stack(sums, axis=1) + self.priors).argmax(axis=1).tolist()


def learn_classes(docs: DataFrame, most: int = 8) -> Classes:
    """docs(text, lang, held_out): naive Bayes over the hashed words of all texts with a language that are not held out."""
    told = docs.where("lang is not null and not held_out")
    sizes = told.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if len(sizes) < 2:
        return Classes(np.zeros((1, 1)), np.zeros(1))
    place, total = {r["lang"]: i for i, r in enumerate(sizes)}, sum(r["count"] for r in sizes)
    columns = [f"n{k}" for k in range(len(place))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for first, end in groups(batch.column("text"), 1 << 20):
                part = batch.slice(first, end - first)
                words = Indexed.of(part.column("text"))
                cells = np.repeat([place.get(x, -1) for x in part.column("lang").to_pylist()], words.lens) * BUCKETS + (words.crc & (BUCKETS - 1))[words.ids]
                sums += np.bincount(cells[cells >= 0], minlength=sums.size).reshape(sums.shape)
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(s[at]) for s in sums)], names=["bucket", *columns])

    found = told.select("text", "lang").mapInArrow(run, ", ".join(["bucket int", *(f"{c} bigint" for c in columns)])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    table = np.full((BUCKETS, len(columns)), 0.5)
    table[found.column("bucket").to_numpy()] += np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    return Classes(np.log(table / table.sum(axis=0)), np.log(np.array([r["count"] for r in sizes]) / total))


def count_tokens(docs: DataFrame, classes: Classes, most: int = 200_000) -> DataFrame:
    """docs(text binary, held_out) -> token, c, z, own: every token of every class of texts that has it, with its count in all rows that are not held out and in those of the class."""
    shared, names = docs.sparkSession.sparkContext.broadcast(classes), ["token", "z", "c"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names[:2], use_threads=False).aggregate([("c", "sum")]).select([*names[:2], "c_sum"]).rename_columns(names).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for first, end in groups(batch.column("text"), 1 << 20):
                words = Indexed.of(batch.column("text").slice(first, end - first))
                z, many = np.repeat(shared.value.of(words), words.lens), len(words.sizes)
                learned = np.repeat(~batch.column("held_out").slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool), words.lens)
                cells = z * many + words.ids
                there = np.flatnonzero(np.bincount(cells))
                times = np.bincount(cells[learned], minlength=many * len(classes.priors))[there]
                held.append(pa.table([words.array.take(pa.array(there % many)), pa.array((there // many).astype(np.int32)), pa.array(times)], names=names))
                if sum(map(len, held)) > 2 * most or sum(t.nbytes for t in held) > 1 << 25:
                    held = [summed(held)]
                    if len(held[0]) > most or held[0].nbytes > 1 << 24:
                        yield from held.pop().to_batches()
        yield from summed(held).to_batches() if held else []

    k = range(len(classes.priors))
    by_class = docs.select("text", "held_out").mapInArrow(run, "token binary, z int, c bigint").groupBy("token").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("z") == z, F.col("c"))).alias(f"c{z}") for z in k])
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(z).alias("z"), F.col(f"c{z}").alias("own")) for z in k]), lambda x: x["own"].isNotNull())).alias("x")
    return by_class.select("token", "c", each).select("token", "c", "x.z", "x.own")


def count_slots(vocabulary: DataFrame, words: int, per_task: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """vocabulary(token, z, own) -> zeros and ones of the hashed predictors, over every token as often as it was seen. What reaches the driver is bounded by SLOTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * SLOTS)  # zeros and ones of a slot side by side
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                text = Spelled(part.column("token"), part.column("z").to_numpy())
                n = np.repeat(part.column("own").to_numpy(), text.lens).astype(np.float64)
                for first, end in text.windows():
                    for bit, slots in text.bits(first, end):
                        for k in range(len(ORDERS)):
                            np.add.at(sums, 2 * slots[k] + bit, n[first:end])
        for first in range(0, SLOTS, 1 << 16):
            part = sums[2 * first : 2 * (first + (1 << 16))].reshape(-1, 2)
            at = np.flatnonzero(part.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array((first + at).astype(np.int32)), *(pa.array(part[at, i]) for i in (0, 1))], names=["slot", "zeros", "ones"])

    seen = vocabulary.where("own > 0").select("token", "z", "own").coalesce(max(1, -(-words // per_task)))
    got = seen.mapInArrow(run, "slot int, zeros double, ones double").groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    out = np.zeros((2, SLOTS), np.float32)
    out[:, got.column("slot").to_numpy()] = got.column("zeros").to_numpy(), got.column("ones").to_numpy()
    return out[0], out[1]


def head_of(token: Column, size: int) -> Column:
    """The first bytes of a token as it is spelled."""
    return F.substring(F.concat(token, F.lit(b" " + bytes(size))), 1, size)


def group_heads(vocabulary: DataFrame, most: int = 50_000, step: int = 3) -> tuple[Column, list[tuple[int, bytes, float]]]:
    """The head by which words of a class are grouped, and (z, head, occurrences) of all groups.

    A head is a word's first 3 bytes, or 3 more as long as over ``most`` words share
    it, up to DEPTH. The list is bounded by the possible heads and by vocabulary / most.
    """
    key, rows, size = head_of(F.col("token"), step), [], step
    rest = vocabulary
    while True:
        head = head_of(F.col("token"), size)
        got = [(r["z"], bytes(r["head"]), float(r["own"]), r["n"]) for r in rest.groupBy("z", head.alias("head")).agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("n")).collect()]
        heavy = [(z, h) for z, h, _, n in got if n > most and size + step <= DEPTH and b" " not in h]
        rows += [r[:3] for r in got if r[:2] not in set(heavy)]
        if not heavy:
            return key, sorted(rows)
        crowded = F.lit(False)
        for z in sorted({z for z, _ in heavy}):
            crowded = crowded | ((F.col("z") == z) & head.isin([F.lit(h) for k, h in heavy if k == z]))
        size += step
        key = F.when(crowded, head_of(F.col("token"), size)).otherwise(key)
        rest = rest.where(crowded)


def head_counts(rows: list[tuple[int, bytes, float]]) -> dict[tuple[int, bytes], np.ndarray]:
    """For each group the counts of zeros and ones along the bits of its head, among all words of its class."""
    if not rows:
        return {}
    z, heads, own = (list(x) for x in zip(*rows, strict=True))
    text = Spelled([h[:-1] for h in heads], np.array(z))  # the ending space stands for the last byte, which is put back
    text.data = text.data.copy()
    text.data[text.starts + text.lens - 1] = [h[-1] for h in heads]
    group = np.cumsum(np.append(0, np.diff(z) != 0))
    counted = Prefixes(text, heads, np.array(own), group, [np.zeros((2, 0), np.float32)] * (int(group[-1]) + 1))
    return {(a, h): counted.counts[:, :, counted.where[at : at + len(h)]].transpose(0, 2, 1).reshape(2, -1).copy() for a, h, at in zip(z, heads, text.starts.tolist(), strict=True)}


def grouped(batches: Iterator[pa.RecordBatch], heads: dict[tuple[int, bytes], np.ndarray], size: int = 1 << 19) -> Iterator[tuple[pa.Table, Spelled, Prefixes]]:
    """Whole groups of words, of about ``size`` bytes at a time, from batches in the order of (z, head, token)."""

    none = np.zeros((2, 0), np.float32)

    def of(table: pa.Table) -> tuple[pa.Table, Spelled, Prefixes]:
        table = table.combine_chunks()
        words, z, keys = (table.column(c).combine_chunks() for c in ("token", "z", "head"))
        text, head = Spelled(words, z.to_numpy()), keys.dictionary_encode().indices.to_numpy()
        new = np.append(True, (np.diff(z.to_numpy()) != 0) | (np.diff(head) != 0))  # equal ones are neighbours
        at = pa.array(np.flatnonzero(new))
        counts = [heads.get(k, none) for k in zip(z.take(at).to_pylist(), keys.take(at).to_pylist(), strict=True)]
        return table, text, Prefixes(text, words, table.column("own").to_numpy().astype(np.float64), np.cumsum(new) - 1, counts)

    held, got = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            got += part.column("token").nbytes
            if got < size:
                continue
            table = pa.Table.from_batches(held)
            z, keys = table.column("z"), table.column("head")
            other = pc.or_(pc.not_equal(z, z[-1]), pc.not_equal(keys, keys[-1])).to_numpy()
            end = int(np.flatnonzero(other).max(initial=-1)) + 1  # the last group may go on
            if end:
                yield of(table.slice(0, end))
            held, got = table.slice(end).to_batches(), 0 if end else got
    if held and sum(b.num_rows for b in held):
        yield of(pa.Table.from_batches(held))


def token_costs(vocabulary: DataFrame, words: int, per_shard: int = 200_000, rate: float = 0.15) -> DataFrame:
    """vocabulary(token, c, z, own) with cost, the model's log10 probability of the token in a text of the class.

    The predictors count all tokens. The mixer is learned from all of them: whole groups
    are dealt by their hash into shards of about ``per_shard`` words, each read online in
    a fixed order, and the shards' weights and refining tables are averaged by the
    occurrences they were learned from, so scores don't depend on how the table is split.
    """
    spark = vocabulary.sparkSession
    model = Model.new()
    model.zeros, model.ones = count_slots(vocabulary, words)
    key, rows = group_heads(vocabulary)
    spelled = F.concat(F.col("token"), F.lit(b" "))  # the order in which words that share bits are neighbours
    heads = head_counts(rows)
    shared = spark.sparkContext.broadcast((model, heads))
    keyed = vocabulary.select("token", "c", "z", "own", key.alias("head"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heads = shared.value
        for shard, pieces in groupby(dealt(batches, 4096), key=itemgetter(0)):
            model, mass = Model(model.zeros, model.ones, Mixer.new()), np.zeros((GATES, GRID))
            for table, text, prefixes in grouped((b for _, t in pieces for b in t.combine_chunks().to_batches()), heads):
                mass += model.learn(text, prefixes, table.column("own").to_numpy(), rate)
            flat = [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (model.mixer.weights, model.mixer.refine, mass)]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *flat], names=["shard", "weights", "refine", "mass"])

    hashed = F.xxhash64("z", "head")
    part = keyed.where("own > 0").select(F.pmod(hashed, F.lit(max(1, words // per_shard))).alias("shard"), hashed.alias("h"), "z", "head", "token", "own")
    learned = part.repartition("shard").sortWithinPartitions("shard", "h", "z", "head", spelled).mapInArrow(train, "shard bigint, weights array<double>, refine array<double>, mass array<double>").collect()
    each = [[np.array(r[c]).reshape(GATES, -1) for c in ("weights", "refine", "mass")] for r in sorted(learned, key=itemgetter("shard"))]
    model.mixer = Mixer(
        averaged([(w, np.repeat(m.sum(axis=1, keepdims=True), w.shape[1], axis=1)) for w, _, m in each], model.mixer.weights),
        averaged([(r, m) for _, r, m in each], model.mixer.refine),
    )
    mixer = model.mixer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heads = shared.value
        model = Model(model.zeros, model.ones, mixer).prepare()
        for table, text, prefixes in grouped(batches, heads):
            out = table.select(["token", "c", "z", "own"]).append_column("cost", pa.array(model.costs(text, prefixes), pa.float64()))
            yield from out.to_batches()

    return keyed.repartition("z", "head").sortWithinPartitions("z", "head", spelled).mapInArrow(run, "token binary, c bigint, z int, own bigint, cost double")


def common_tokens(costs: DataFrame, most: int) -> pa.Table:
    """The most frequent tokens, at most ``most`` of them: those above a count read off a histogram of some hundred cells."""
    cell = F.floor(F.log2(F.col("own")) * 16)
    cells = sorted((r["cell"], r["n"]) for r in costs.where("own > 0").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, held = None, 0
    for at, n in reversed(cells):
        held += n
        if held > most:
            break
        least = at
    return costs.where((F.col("own") > 0) & (cell >= least) if least is not None else F.lit(False)).select("token", "z", "c", "cost").toArrow()


def scored(docs: DataFrame, most_common: int = 1 << 17) -> DataFrame:
    """docs(doc_id, text, lang, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    The model sees a text as its lower-cased words and one end, like the base: first
    its class (a language, told from its words); then for each word, whether it
    is the one that followed when the two words before (then the one word before) stood
    last in the text; if not, its bytes, 8 binary decisions each. All decisions are
    mixed predictions, and the probabilities of all texts add up to at most one. The
    bytes of a word cost the same wherever it stands in texts of a class, so they are
    worked out once for the corpus; what the predictors know of whole words grows with
    the vocabulary. Frequent words (at most ``most_common``, a parameter that bounds the
    broadcast) are looked up while a text is read; the others are joined. lang is used
    only of rows that are learned from, those not held out. A null or empty text is one
    end. With nothing to learn from the predictors know nothing (about one bit a bit).
    Repeated rows are scored alike and each counts as often as it stands.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "held_out", "lang", F.col("text").cast("binary").alias("text"))
    classes = learn_classes(rows)
    repeats = learn_repeats(rows)
    vocabulary = cut(count_tokens(rows, classes), "vocabulary")
    total, words = vocabulary.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count(F.lit(1))).first()
    distinct = vocabulary.where("c > 0").select("token").distinct().count() if len(classes.priors) > 1 else vocabulary.where("c > 0").count()
    costs = cut(token_costs(vocabulary, words), "token-costs")
    drop_cut(vocabulary)
    table = common_tokens(costs, most_common)
    place: dict[bytes, int] = {}
    at = [place.setdefault(t, len(place)) for t in table.column("token").to_pylist()]
    logs, cost = np.zeros(len(place) + 1), np.full((len(place) + 1, len(classes.priors)), np.nan, np.float32)
    logs[at], cost[at, table.column("z").to_numpy()] = np.log10(table.column("c").to_numpy() + 1.0), table.column("cost").to_numpy()
    shared = spark.sparkContext.broadcast((classes, repeats, place, logs, cost))
    del table, place, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, repeats, place, logs, cost = shared.value
        for batch in batches:
            for first, end in groups(batch.column("text"), 1 << 20):
                part = batch.slice(first, end - first)
                words = Indexed.of(part.column("text"))
                z, followers = np.array(classes.of(words), np.int64), Followers(words)
                told, left = np.zeros(len(words.ids)), np.ones(len(words.ids), bool)
                for some, contexts, hit in followers.questions():
                    p = repeats.probability(contexts)
                    told[some] += np.log10(np.where(hit, p, 1 - p))
                    left[some[hit]] = False
                rows = np.fromiter((place.get(t, len(logs) - 1) for t in words.distinct), np.int64, len(words.sizes))[words.ids]
                spelled = cost[rows, np.repeat(z, words.lens)].astype(np.float64)
                here = ~np.isnan(spelled)
                sizes = words.sizes[words.ids] + 1
                add = lambda x: np.add.reduceat(x, words.starts) if len(words.ids) else x[:0]
                whole = [words.lens, 0 * words.lens, add(np.where(here, logs[rows], 0)), add(here.astype(np.int64)), add(told + np.where(here & left, spelled, 0)) + classes.priors[z] / math.log(10), add(sizes)]
                # words that the table hasn't: one row for each text and word
                rare = np.flatnonzero(~here)
                pair, inverse = np.unique(np.repeat(np.arange(len(z)), words.lens)[rare] * (len(words.sizes) + 1) + words.ids[rare], return_inverse=True)
                text, word = pair // (len(words.sizes) + 1), pair % (len(words.sizes) + 1)
                times, bare = np.bincount(inverse, minlength=len(pair)), np.bincount(inverse, left[rare], len(pair)).astype(np.int64)
                none = np.zeros(len(pair))
                more = [times, bare, none, none.astype(np.int64), none, none.astype(np.int64)]
                taken = pa.array(np.concatenate((np.arange(len(z)), text)))
                token = pa.concat_arrays([pa.nulls(len(z), pa.binary()), words.array.take(pa.array(word))])
                columns = [pa.array(np.concatenate(x), kind) for x, kind in zip(zip(whole, more, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
                names = ["rid", "doc_id", "held_out", "token", "z", "n", "m", "base", "known", "model", "size"]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(taken) for c in names[:3]), token, pa.array(np.concatenate((z, z[text])), pa.int32()), *columns], names=names)

    schema = f"rid bigint, doc_id {kind}, held_out boolean, token binary, z int, n bigint, m bigint, base double, known bigint, model double, size bigint"
    held = cut(rows.drop("lang").withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, schema), "tokens")
    whole = held.where("token is null").select("rid", "doc_id", "held_out", "n", "base", "known", "model", "size")
    rare = held.where("token is not null").select("rid", "token", "z", "n", "m").join(costs.select("token", "z", "c", "cost"), ["token", "z"])
    none = lambda k: F.lit(None).cast(k)
    sums = whole.unionByName(
        rare.select("rid", none(kind).alias("doc_id"), none("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n"), (F.log10(F.col("c") + 1) * F.col("n")).alias("base"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("cost") * F.col("m")).alias("model"), F.lit(0).cast("bigint").alias("size"))
    )
    by_row = sums.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n", "base", "known", "model", "size")])
    return by_row.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        F.col("model").alias("score"),
        F.col("size").alias("n_bytes"),
        (-F.col("model") / F.lit(math.log10(2)) / F.col("size")).alias("bits_per_byte"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document; see scored."""
    return scored(documents(load(spark, sf_dir, "documents"), "lang").withColumn("held_out", fold(F.col("doc_id"), 7) == 2))
