"""Benchmark decontamination by spaced seeds: fixed masks skip token positions, hits are verified with substitutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, load

#: Fixed masks: positions that are compared. A stretch of 6 words or more with 80 % alike has one of them: without four equal words in
#: a row, m >= 4 x alike of x changed leave x <= 3, and then three equal words lie one change from two others (tests try them all).
MASKS = ("1111", "111011", "110111")
#: Further masks of items of so few words; four words are wholly in MASKS. Documents are read by them only if there are such items.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "10111", "11101")}
ALL = (*MASKS, *(m for few in SHORT.values() for m in few))
#: ASCII other than letters and digits separates words; A-Z are lower-cased (other letters before, by str.lower).
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
#: Slots of the two filters, as powers of two; fixed, whatever the benchmark holds.
FILTER_BITS = (22, 26)


class Words(dict):
    """Word -> 64-bit hash; holds at most ``most`` words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        if not text:
            return np.zeros(0, np.uint64)
        low = text if text.isascii() else text.decode().lower().encode()
        return np.array([self[w] for w in low.translate(FOLD).split()], dtype=np.uint64)


def seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[np.ndarray]:
    """Per mask the hash at every position where it fits: a sum of word hashes, each times an odd factor of its place."""
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        out = np.full(n, ALL.index(mask) + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                out += words[j : j + n] * np.uint64(2 * (0x9E3779B97F4A7C15 * (j + 1) >> 3 & (1 << 60) - 1) + 1)
        yield out ^ (out >> np.uint64(29))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> seed, item_id, item_hash, at, mask: all masked seeds of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = held.of(text)
                masks = (*MASKS, *SHORT.get(len(words), ()))
                for mask, hashes in zip(masks, seeds(words, masks), strict=True):
                    n = len(hashes)
                    take = pa.array(np.full(n, i, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("item_id").take(take), batch.column("item_hash").take(take), pa.array(np.arange(n, dtype=np.int32)), pa.array([mask] * n, pa.string())], names=["seed", "item_id", "item_hash", "at", "mask"])

    rows = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"seed bigint, item_id {_kind(benchmark, 'item_id')}, item_hash bigint, at int, mask string").distinct()


def word_hashes(table: DataFrame, *kept: str) -> DataFrame:
    names = list(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            words = [held.of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(words, pa.list_(pa.int64()))], names=[*names, "words"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*names).schema)
    return table.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{out}, words array<bigint>")


def filters(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit tables of fixed size, set from the seeds: the driver gets at most as many numbers as they have slots."""
    out = []
    for bits, shift in zip(FILTER_BITS, (0, 32), strict=True):
        slot = F.call_function("shiftrightunsigned", F.col("seed"), F.lit(shift)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
        table = np.zeros(1 << bits, bool)
        table[found.select(slot.alias("s")).distinct().toArrow().column("s").to_numpy()] = True
        out.append(np.packbits(table, bitorder="little"))
    return out[0], out[1]


def _set_in(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def regions(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray], reach: int, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """docs(doc_id, text) -> stretches of words around seeds that may be the benchmark's: words and the seeds in them.

    The filters only thin out: they let every true seed pass and about one other in
    ten million, whatever the number of documents. Stretches reach ``reach`` words
    beyond their outer seeds and end where seeds lie further apart.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(tables), _kind(docs, "doc_id")
    low, high = (np.uint64((1 << b) - 1) for b in FILTER_BITS)

    def found(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, seed = [], []
        for hashes in seeds(words, masks):
            near = np.flatnonzero(_set_in(shared.value[0], hashes & low))
            near = near[_set_in(shared.value[1], (hashes[near] >> np.uint64(32)) & high)]
            at.append(near)
            seed.append(hashes[near])
        at_all = np.concatenate(at)
        order = np.argsort(at_all, kind="stable")
        return at_all[order], np.concatenate(seed)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(first, 256)
                take, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = held.of(text)
                    at, seed = found(words)
                    if not len(at):
                        continue
                    for places in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                        start, stop = max(0, int(at[places[0]]) - reach), min(len(words), int(at[places[-1]]) + reach + max(map(len, MASKS)))
                        take.append(i)
                        rows.append((start, words[start:stop].view(np.int64), (at[places] - start).astype(np.int32), seed[places].view(np.int64)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                taken = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(taken), part.column("text_hash").take(taken), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "start", "words", "at", "seeds"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, start int, words array<bigint>, at array<int>, seeds array<bigint>").distinct()


def longest_stretch(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """Start, end and matches of the longest stretch (the first of them) whose share of matches is at least identity."""
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - identity, -identity)))) + 1e-9 * np.arange(len(same) + 1)  # 1e-9: sums of floats
    starts = np.searchsorted(-np.minimum.accumulate(gain), -gain)  # per end the first start from which the sum is not below 0
    lengths = np.arange(len(gain)) - starts
    end = int(np.argmax(lengths))
    start = int(starts[end])
    return start, end, int(same[start:end].sum())


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, identity: float = 0.8, reach: int = 64, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Overlaps of docs(doc_id, text) with benchmark(item_id, text): doc_id, item_id, doc_start, item_start, n_words, n_same.

    One row per document, item and diagonal with a seed on which a stretch of
    ``min_words`` words or more (or the whole item, if that is shorter) has ``identity``
    of them alike; the row is of the longest such stretch. A stretch is followed for ``reach`` words beyond its outer seeds.
    Items of under 6 words have masks of their own. Null texts have no words; rows equal in id and text count once; an empty table on either side gives
    an empty result. The seeds of the benchmark, and the words of its items, are
    broadcast up to ``broadcast_rows`` of them each, beyond that the joins are shuffled.
    """
    spark = docs.sparkSession
    items = cut(benchmark_seeds(benchmark), "item-seeds")
    used = {r["mask"] for r in items.select("mask").distinct().collect()}
    stretches = cut(regions(docs, filters(items), reach, tuple(m for m in ALL if m in MASKS or m in used)), "regions").withColumn("region", F.xxhash64("doc_id", "text_hash", "start"))
    hits = stretches.select("region", F.explode(F.arrays_zip("at", "seeds")).alias("x")).select("region", F.col("x.at").alias("doc_at"), F.col("x.seeds").alias("seed"))
    small = items.count() <= broadcast_rows
    met = hits.join(F.broadcast(items) if small else items, "seed")
    diagonals = cut(met.groupBy("region", "item_id", "item_hash", (F.col("doc_at") - F.col("at")).alias("diagonal")).agg(F.min("at").alias("item_at")), "diagonals")
    seeded = items.select("item_id", "item_hash").distinct()
    texts = cut(word_hashes(benchmark.withColumn("item_hash", F.xxhash64("text")), "item_id", "item_hash").distinct().withColumnRenamed("words", "item_words").join(F.broadcast(seeded) if small else seeded, ["item_id", "item_hash"], "left_semi"), "item-texts")
    light = (texts.agg(F.sum(F.size("item_words"))).first()[0] or 0) <= broadcast_rows
    joined = diagonals.join(F.broadcast(texts) if light else texts, ["item_id", "item_hash"]).join(stretches.select("region", "doc_id", "start", "words"), "region")
    doc_kind, item_kind = _kind(docs, "doc_id"), _kind(benchmark, "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            lists = [(batch.column(n).values.to_numpy(), batch.column(n).offsets.to_numpy()) for n in ("words", "item_words")]
            for i, (diagonal, start) in enumerate(zip(batch.column("diagonal").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                words, item = (v[o[i] : o[i + 1]] for v, o in lists)
                low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
                a, b, same = longest_stretch(words[low + diagonal : high + diagonal] == item[low:high], identity)
                if b - a >= min(min_words, len(item)):
                    take.append(i)
                    rows.append((start + low + a + diagonal, low + a, b - a, same))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            taken = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("item_id").take(taken), *(pa.array(c, pa.int32()) for c in cols)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"])

    out = joined.select("doc_id", "item_id", "diagonal", "start", "words", "item_words").mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, doc_start int, item_start int, n_words int, n_same int")
    return out.distinct()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every contaminated pair with its overlaps; see overlaps."""
    return overlaps(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text"))
