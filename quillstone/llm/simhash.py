"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, drop_cut, load
from quillstone.llm.components import stars

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3, step: int = 1 << 16) -> int:
    """64 bits; one is 1 if set in over half the shingle hashes, repeats included. No words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    if n == 1:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, step):
        a, b = starts[at : min(at + step, n)].tolist(), ends[at + shingle - 1 : min(at + step, n) + shingle - 1].tolist()
        hashes = np.array([hashed(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns without text, with fp (the 64 bits as a signed bigint) in place of older ones of that name."""
    kept = [f for f in docs.schema if f.name not in ("text", "fp", "component_id")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                fps = [fingerprint(t, shingle) for t in column.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*names, "fp"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{out}, fp bigint")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - distance blocks: bits that differ in at most ``distance`` places leave one choice alike."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(f: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links among f that connect whatever is connected at ``distance`` differing bits; each element is reached once."""
    left, right, rest, stack = [], [], np.arange(1, len(f)), [0]
    while len(rest):
        if not stack:
            stack, rest = [int(rest[0])], rest[1:]
            continue
        i = stack.pop()
        close = np.bitwise_count(f[rest] ^ f[i]) <= distance
        if close.any():
            got = rest[close].tolist()
            left += [i] * len(got)
            right += got
            stack += got
            rest = rest[~close]
    return left, right


def links_in_runs(distance: int):
    """For mapInArrow over (mask, part, fp) in order of (mask, part): links inside each run of equal (mask, part)."""

    def of(mask: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
        pairs = starts[ends - starts == 2]
        pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
        a, b = [fp[pairs]], [fp[pairs + 1]]
        for i, j in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            left, right = spanning(fp[i:j], distance)
            a.append(fp[i:j][left])
            b.append(fp[i:j][right])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            changes = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(changes):  # the last run may go on in the next batch
                end = changes[-1] + 1
                yield of(*(x[:end] for x in held))
                held = [x[end:].copy() for x in held]
        if held is not None and len(held[0]):
            yield of(*held)

    return run


def links(prints: DataFrame, distance: int = 3, blocks: int = 6, cap: int = 20000) -> DataFrame:
    """prints(fp, distinct) -> (a, b): verified links that connect all fingerprints within ``distance`` bits of one another.

    Fingerprints meet in blocks of equal chosen bits. A block of up to ``cap``
    fingerprints is spanned in one task, which emits fewer links than it has
    fingerprints; those of larger blocks meet by flipped bits instead (see dense_links),
    which needs no group to be held whole. Both ways are exact.
    """
    masks = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("bigint")).alias("part")) for k, m in enumerate(block_masks(distance, blocks))])).alias("at")
    dealt = prints.select("fp", masks).select("at.mask", "at.part", "fp")
    shared = dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(dealt.join(shared, ["mask", "part"]).select("mask", "part", "fp", "n"), "blocks")
    usual = met.where(F.col("n") <= cap).select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(links_in_runs(distance), "a bigint, b bigint")
    large = met.where(F.col("n") > cap).select("fp").distinct()
    return usual if large.isEmpty() else usual.unionByName(dense_links(large, distance))


def dense_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """The same for fingerprints of crowded blocks: a and b are within 3 bits just if some value is within 1 bit of one and 2 of the other.

    Each fingerprint goes to its 1 + 64 + 2016 neighbours of up to two flipped bits; a
    neighbour that some fingerprint reaches by at most one flip links all that reach
    it to the least such one. A group holds at most 2081 fingerprints.
    """
    if distance != 3:
        raise ValueError("flipped bits are worked out for a distance of 3")
    flips = [(0, True)] + [(signed(1 << i), True) for i in range(64)] + [(signed((1 << i) | (1 << j)), False) for i, j in combinations(range(64), 2)]
    table = F.explode(F.expr("array(" + ",".join(f"struct({v}L as v, {str(n).lower()} as near)" if v != -(1 << 63) else f"struct(shiftleft(1L, 63) as v, {str(n).lower()} as near)" for v, n in flips) + ")")).alias("x")
    reached = prints.select("fp", table).select(F.col("fp").bitwiseXOR(F.col("x.v")).alias("at"), "fp", "x.near")
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("at"))
    return reached.withColumn("hub", hub).where("hub is not null and hub <> fp").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6, cap: int = 20000) -> DataFrame:
    """docs(doc_id, text, ...) -> the columns without text, with fp and component_id (the least doc_id reachable).

    Equal fingerprints are one node from the start, so exact copies make no links.
    Texts without words have fingerprint 0 and are linked like any other; a null
    doc_id never is the least one of a component unless it has no other (then the
    component is null). Repeated rows stay.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = stars(links(nodes.select("fp"), distance, blocks, cap))
    labelled = cut(nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "labelled")
    least = cut(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
    of_fp = cut(labelled.join(least, "root").select("fp", "component_id"), "components")
    for done in (nodes, roots, labelled, least):
        drop_cut(done)
    return prints.join(of_fp, "fp")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; see near_duplicates for nulls and repeats."""
    found = near_duplicates(documents(load(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
