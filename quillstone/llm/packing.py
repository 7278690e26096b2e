"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, drop_cut, load

CAPACITY = 4096
END = (1).to_bytes(4, "little")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks; a run of them after letters is a token of its own to the vocabulary's splitter.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Ids:
    """Ids of texts, by chunks without white space: the vocabulary drops white space and never joins across it, so a
    text's ids are those of its chunks in order.

    A chunk of letters and up to four closing marks is its letters' ids and the marks'; any other chunk is one word by
    itself. The words of letters that are new in a group of texts are encoded in few calls, each ending at an id of the
    vocabulary that ends a word; the others one by one. The cache takes in short words that come up a second time (told
    by a table of bits), and a full one becomes the older of two, whose words in use move on; a process keeps it from
    task to task.
    """

    def __init__(self, path: str, most: int = 100_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.longest, self.most = Tokenizer.from_file(path), longest, most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen = np.zeros(1 << 22, bool)

    def encoded(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encoded_words(self, words: tuple[str, ...]) -> list[bytes]:
        """The ids of each of some words of letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return [self.encoded(w) for w in words]
        raw = ids.tobytes()
        return list(map(raw.__getitem__, map(slice, [0, *stops], stops)))

    def of_words(self, words: list[str], letters: list[bool]) -> list[bytes]:
        """The ids of each of some distinct words, as little-endian bytes."""
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        held, older, new = self.words, self.older, []
        out = list(map(held.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            ids = older.get(word)
            if ids is not None:
                held[word] = out[i] = ids
            elif letters[i]:
                new.append(i)
            else:
                out[i] = self.encoded(word)
                if len(word) <= self.longest:
                    held[word] = out[i]
        bits = np.fromiter(map(hash, map(words.__getitem__, new)), np.int64, len(new)) & (len(self.seen) - 1)
        again = self.seen[bits].tolist()
        self.seen[bits] = True
        for group in batched(zip(new, again, strict=True), 2000):
            for (i, known), ids in zip(group, self.encoded_words(tuple(words[i] for i, _ in group)), strict=True):
                out[i] = ids
                if known:
                    held[words[i]] = ids
        return out

    def split(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Of each chunk its word (letters in lower case, or the whole chunk), and its closing marks as the digits of a number."""
        word = pc.utf8_rtrim(chunks, MARKS)
        size = pc.binary_length(chunks)
        marks = pc.subtract(size, pc.binary_length(word))
        plain = pc.and_(pc.and_(pc.utf8_is_alpha(word), pc.less_equal(marks, 4)), pc.less_equal(size, self.longest))
        marks = np.where(plain.to_numpy(zero_copy_only=False), marks.to_numpy(), 0)
        codes = np.zeros(len(chunks), np.uint32)
        if len(chunks):
            ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset + 1 : chunks.offset + 1 + len(chunks)]
            data = np.frombuffer(chunks.buffers()[2], np.uint8) if chunks.buffers()[2] else np.zeros(1, np.uint8)
            for j in range(4, 0, -1):
                some = np.flatnonzero(marks >= j)
                codes[some] = (codes[some] << np.uint32(8)) | data[ends[some] - j]
        return pc.if_else(plain, pc.ascii_lower(word), chunks), codes

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one text after the other, and the place where each text's ids end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        told = split.flatten().dictionary_encode()
        word, codes = self.split(told.dictionary)
        word = word.dictionary_encode()
        each = self.of_words(word.dictionary.to_pylist(), pc.utf8_is_alpha(word.dictionary).to_pylist())
        codes, mark = np.unique(codes, return_inverse=True)
        each += [self.encoded(int(c).to_bytes(4, "big").lstrip(b"\0").decode()) for c in codes]
        sizes = np.fromiter(map(len, each), np.int32, len(each)) // 4
        flat, firsts = np.frombuffer(b"".join(each), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        at = told.indices.to_numpy()
        units = np.empty((len(at), 2), np.int32)
        units[:, 0], units[:, 1] = word.indices.to_numpy()[at], (len(word.dictionary) + mark)[at]
        units = units.ravel()
        units = units[sizes[units] > 0]
        sizes = sizes[units]
        ends = np.cumsum(sizes, dtype=np.int32)
        where = np.repeat(firsts[units] - (ends - sizes), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return flat[where], self.bounds(split, told, each, word, mark)

    @staticmethod
    def bounds(split: pa.ListArray, told: pa.DictionaryArray, each: list[bytes], word: pa.DictionaryArray, mark: np.ndarray) -> np.ndarray:
        """Where each text's ids end."""
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        of_chunk = sizes[word.indices.to_numpy()] + sizes[len(word.dictionary) + mark]
        ends = np.concatenate(([0], np.cumsum(of_chunk[told.indices.to_numpy()])))
        return ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]


@cache
def held_ids(path: str) -> Ids:
    return Ids(path)


def groups(texts: pa.Array, size: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """First and end of runs of rows with about ``size`` bytes of text; a longer text is a run of its own."""
    ends, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield first, end
        first = end


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32: each document's ids and END, cut only if longer than capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_ids(path)
        for batch in batches:
            texts = batch.column("text")
            for first, end in groups(texts):
                take, rows, begin = [], [], 0
                ids, stops = held.of(texts.slice(first, end - first))
                raw = memoryview(ids).cast("B")
                for i, stop in enumerate(stops.tolist()):
                    n = stop - begin + 1
                    for piece, start in enumerate(range(0, n, capacity)):
                        cut_at = min(start + capacity, n)
                        crc = zlib.crc32(raw[4 * (begin + start) : 4 * (begin + min(cut_at, n - 1))])
                        take.append(first + i)
                        rows.append((piece, start, cut_at - start, zlib.crc32(END, crc) if cut_at == n else crc))
                    begin = stop
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(take, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """A packing: lists of items, with the room left in each; best fit by one bit for each amount of room."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, rooms: list[int] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.rooms = rooms if rooms is not None else [capacity - sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> None:
        """Put items, largest first, each into the bin with the least room that holds it."""
        at: dict[int, list[int]] = {}
        mask = 0
        for b, room in enumerate(self.rooms):
            at.setdefault(room, []).append(b)
            mask |= 1 << room
        for i in items:
            size = self.sizes[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = at[room].pop()
                if not at[room]:
                    mask ^= 1 << room
                self.bins[b].append(i)
                left = room - size
                self.rooms[b] = left
            else:
                b, left = len(self.bins), self.capacity - size
                self.bins.append([i])
                self.rooms.append(left)
            held = at.setdefault(left, [])
            held.append(b)
            mask |= 1 << left

    def fitness(self) -> float:
        """Fewer bins first; among equals, fuller full ones: the mean square of the fill."""
        return sum((1 - r / self.capacity) ** 2 for r in self.rooms) / len(self.rooms) - len(self.rooms)

    def owner(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def crossed(a: Bins, b: Bins, rnd: random.Random, order: list[int]) -> Bins:
    """A child of a with well-filled bins of b injected whole; bins of a that share an item go, their other items are best-fitted."""
    count = max(1, len(b.bins) // 4)
    first = rnd.randrange(max(1, len(b.bins) // 2))
    ranked = sorted(range(len(b.bins)), key=lambda i: b.rooms[i])
    chosen = ranked[first : first + count]
    taken = {i for k in chosen for i in b.bins[k]}
    kept, loose = [], set()
    for k, items in enumerate(a.bins):
        if taken.isdisjoint(items):
            kept.append(k)
        else:
            loose.update(items)
    loose -= taken
    child = Bins(a.sizes, a.capacity, [list(a.bins[k]) for k in kept] + [list(b.bins[k]) for k in chosen], [a.rooms[k] for k in kept] + [b.rooms[k] for k in chosen])
    worst = sorted(range(len(kept)), key=lambda i: -child.rooms[i])[: 1 + len(kept) // 20]  # mutation: the emptiest bins go too
    for k in sorted((k for k in worst if child.rooms[k]), reverse=True):
        loose.update(child.bins.pop(k))
        child.rooms.pop(k)
    child.best_fit([i for i in order if i in loose])
    return child


def evolved(sizes: list[int], capacity: int, founders: list[list[int]], seed: int, generations: int, population: int = 6) -> Bins:
    """The best packing of an island: best fit in falling order, the founders (packings that came in) and random orders, crossed again and again."""
    rnd = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    members = []
    for owner in founders:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(owner):
            bins.setdefault(b, []).append(i)
        members.append(Bins(sizes, capacity, list(bins.values())))
    while len(members) < population:
        own = Bins(sizes, capacity)
        own.best_fit(order if not members else sorted(order, key=lambda i: -sizes[i] * rnd.uniform(0.6, 1.0)))
        members.append(own)
    least = -(-sum(sizes) // capacity)
    scored = sorted(((m.fitness(), k, m) for k, m in enumerate(members)), reverse=True)
    for g in range(generations):
        if len(scored[0][2].bins) == least:
            break
        a, b = (scored[min(rnd.randrange(population), rnd.randrange(population))][2] for _ in range(2))
        child = crossed(a, b, rnd, order)
        scored[-1] = (child.fitness(), population + g, child) if child.fitness() > scored[-1][0] else scored[-1]
        scored.sort(reverse=True)
    return scored[0][2]


def _evolve_rows(capacity: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                best = evolved(r["sizes"], capacity, [f for f in r["founders"] or [] if f], hash((r["block"], r["island"], epoch)), generations)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([best.owner()], pa.list_(pa.int32())), pa.array([best.fitness()], pa.float64())],
                    names=["block", "island", "owner", "fitness"],
                )

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = 1024, islands: int = 2, epochs: int = 2, generations: int = 24, full: float = 0.998, levels: int = 8) -> DataFrame:
    """items(pid, length), pid distinct -> pid, sequence_id, offset.

    Items of full length are sequences by themselves. The others go by hash into
    blocks of about ``block``; islands evolve packings of a block apart and pass their
    best to the next island after each epoch. Of the best packing, bins filled to
    ``full`` stay; what is in the others meets in fewer blocks of the next level, until
    one block is left or little is gained. No task sees more than a block.
    """
    done = [items.where(F.col("length") >= capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    loose = items.where(F.col("length") < capacity).select("pid", F.col("length").cast("int").alias("length"))
    n, before_n = loose.count(), 0
    for level in range(levels):
        if not n:
            break
        last = n <= block or level == levels - 1 or (level > 0 and n > 0.9 * before_n)
        count = -(-n // block)
        salt = F.xxhash64(F.col("pid"), F.lit(level))
        blocks = cut(
            loose.groupBy(F.pmod(salt, F.lit(count)).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pid"), F.col("length")))).alias("held"))
            .select("block", F.col("held.pid").alias("pids"), F.col("held.length").alias("sizes")),
            "blocks",
        )
        island = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
        state, spent = blocks.select("block", island, "sizes", F.lit(None).cast("array<array<int>>").alias("founders")), []
        for epoch in range(epochs):
            width = max(1, min(count * islands, 4 * items.sparkSession.sparkContext.defaultParallelism))
            best = cut(state.repartition(width, "block", "island").mapInArrow(_evolve_rows(capacity, generations, epoch), "block bigint, island int, owner array<int>, fitness double"), "elites")
            spent.append(best)
            moved = best.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("owner").alias("came"))
            state = best.join(moved, ["block", "island"]).join(blocks.select("block", "sizes"), "block").select("block", "island", "sizes", F.array("owner", "came").alias("founders"))
        winner = spent[-1].groupBy("block").agg(F.max_by("owner", F.struct("fitness", "island")).alias("owner"))
        packed = winner.join(blocks, "block").select("block", F.explode(F.arrays_zip("owner", "pids", "sizes")).alias("x")).select("block", "x.owner", F.col("x.pids").alias("pid"), F.col("x.sizes").alias("length"))
        bins = packed.groupBy("block", "owner").agg(F.min("pid").alias("sequence_id"), F.sum("length").alias("fill"), F.array_sort(F.collect_list(F.struct("pid", "length"))).alias("held"))
        out = cut(bins.select("sequence_id", "fill", "held"), "bins")
        stays = F.lit(True) if last else F.col("fill") >= full * capacity
        before = lambda i: F.aggregate(F.slice("held.length", 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x)
        placed = out.where(stays).select("sequence_id", F.explode(F.transform("held", lambda x, i: F.struct(x["pid"].alias("pid"), before(i).alias("offset")))).alias("x"))
        done.append(placed.select("x.pid", "sequence_id", "x.offset"))
        for old in (blocks, *spent):
            drop_cut(old)
        if last:
            break
        loose = out.where(~stays).select(F.explode("held").alias("x")).select("x.pid", "x.length")
        n, before_n = loose.count(), n
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one token (END) long. Repeated rows are pieces of their
    own. Ties of room or length are broken by position, so a rerun over the same
    written pieces packs alike. An empty table gives an empty result.
    """
    rows = cut(pieces(docs, path or vocabulary_path(), capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows.select("pid", "length"), capacity), "pid").drop("pid")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place; see packed_documents."""
    return packed_documents(documents(load(spark, sf_dir, "documents")))
