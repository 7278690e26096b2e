"""Line dedup by winnowing: window minima of line hashes meet, matches grow both ways, later repeated runs go."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, drop_cut, load


def winnowed(hashes: list[int], words: list[int], min_words: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Picked positions, their fingerprints, and for each the hashes of the stretches that picked it.

    The fingerprint of a line is the hash of the shortest run of lines from it on that has half
    of min_words words. Each shortest stretch of min_words words picks the least fingerprint (the last of equal ones)
    that lies in it whole, so two texts that share such a stretch pick the same line of it, and neighbouring
    stretches mostly pick one line together.
    """
    raw, n = np.array(hashes, np.uint64).tobytes(), len(hashes)
    of = lambda first, last: xxhash.xxh64_intdigest(raw[8 * first : 8 * last + 8])
    ends, grams, end, held = [], [], -1, 0
    for first in range(n):
        while held < min_words / 2 and end + 1 < n:
            end += 1
            held += words[end]
        if held < min_words / 2:
            break
        ends.append(end)
        grams.append(of(first, end))
        held -= words[first]
    picked: dict[int, list[int]] = {}
    start, held = 0, 0
    for last, k in enumerate(words):
        held += k
        while held - words[start] >= min_words:
            held -= words[start]
            start += 1
        if held >= min_words:
            inside = range(start, max(start + 1, bisect_right(ends, last)))
            picked.setdefault(min(inside, key=lambda i: (grams[i], -i)), []).append(of(start, last))
    places = sorted(picked)
    return places, [grams[i] for i in places], [picked[i] for i in places]


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash and arrays over the lines with a word: hash, number in the text, words; picked positions, fingerprints, stretches."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(first, 256)
                cols: list[list] = [[] for _ in range(6)]
                for text in part.column("text").to_pylist():
                    lines = [(n, line.split()) for n, line in enumerate((text or b"").split(b"\n"))]
                    lines = [(n, w) for n, w in lines if w]
                    hashes, words = [xxhash.xxh64_intdigest(b" ".join(w)) for _, w in lines], [len(w) for _, w in lines]
                    places, grams, stretches = winnowed(hashes, words, min_words)
                    bits = lambda x: np.array(x, np.uint64).view(np.int64)
                    for c, v in zip(cols, (bits(hashes), [n for n, _ in lines], words, places, bits(grams), [bits(x) for x in stretches]), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "text_hash", "hashes", "numbers", "words", "picked", "prints", "stretches"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, hashes array<bigint>, numbers array<int>, words array<int>, picked array<int>, prints array<bigint>, stretches array<array<bigint>>")


def _grow(min_words: int):
    """For mapInArrow over pairs of a later and an earlier text with positions that match: runs of lines of the later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("places", "hashes", "numbers", "words", "old_hashes")
            take, rows = [], []
            lists = {n: (batch.column(n).flatten(), batch.column(n).offsets.to_numpy() - batch.column(n).offsets[0].as_py()) for n in names}
            places = {k: lists["places"][0].field(k).to_numpy() for k in ("at", "old_at")}
            values = {n: lists[n][0].to_numpy() for n in names[1:]}
            for i in range(batch.num_rows):
                of = lambda n, i=i: values[n][lists[n][1][i] : lists[n][1][i + 1]]
                new, numbers, words, old = of("hashes"), of("numbers"), of("words"), of("old_hashes")
                a, b = lists["places"][1][i : i + 2]
                seen: dict[int, int] = {}  # diagonal -> end of its last run
                for at, old_at in sorted(zip(places["at"][a:b].tolist(), places["old_at"][a:b].tolist(), strict=True)):
                    if seen.get(at - old_at, -1) > at:
                        continue
                    back = _alike(new[:at][::-1], old[:old_at][::-1])
                    ahead = _alike(new[at:], old[old_at:])
                    seen[at - old_at] = at + ahead
                    if words[at - back : at + ahead].sum() >= min_words:
                        take.append(i)
                        rows.append((int(numbers[at - back]), int(numbers[at + ahead - 1])))
            taken = pa.array(take, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), batch.column("text_hash").take(taken), *(pa.array(c, pa.int32()) for c in cols)], names=["doc_id", "text_hash", "first", "last"])

    return run


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, runs: numbers of the first and last line of each run that stands earlier in the table.

    Earlier is by (doc_id, text hash, line). A run is a stretch of consecutive lines
    with a word, alike up to white space, of ``min_words`` words or more. Picked
    positions whose fingerprint stands more than once meet; of these every one meets
    only the earliest that was picked by the same stretch, so a line that half the
    table shares makes one pair per text, not one for every two, and the earliest text
    always shares a run that is long enough; the match then grows line by line. The earliest of equal lines is never part of a run, so one copy stays.
    Found for certain is every line of a shortest stretch of ``min_words`` words that
    stands earlier; lines beside it go as far as the earliest place agrees.
    """
    table = cut(line_table(docs, min_words).dropDuplicates(["doc_id", "text_hash"]), "lines")
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = table.select("doc_id", "text_hash", F.explode(F.arrays_zip("picked", "prints", "stretches")).alias("x")).select(F.col("x.prints").alias("print"), "doc_id", "text_hash", F.col("x.picked").alias("at"), "x.stretches")
    repeated = picked.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    met = cut(picked.join(repeated, "print").select(F.explode("stretches").alias("hash"), "doc_id", "text_hash", "at"), "met-lines")
    first = cut(met.groupBy("hash").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("old"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "old"), "earliest")
    later = met.join(first, "hash").where(~(F.struct("doc_id", "text_hash", "at").eqNullSafe(F.col("old"))))
    pairs = cut(
        later.groupBy("doc_id", "text_hash", F.col("old.doc_id").alias("old_id"), F.col("old.text_hash").alias("old_hash")).agg(F.collect_list(F.struct("at", F.col("old.at").alias("old_at"))).alias("places")),
        "line-pairs",
    )
    new = table.select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), "hashes", "numbers", "words")
    old = table.select(F.col("doc_id").alias("o1"), F.col("text_hash").alias("o2"), F.col("hashes").alias("old_hashes"))
    joined = pairs.join(new, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2"))).join(old, F.col("old_id").eqNullSafe(F.col("o1")) & (F.col("old_hash") == F.col("o2")))
    runs = joined.select("doc_id", "text_hash", "places", "hashes", "numbers", "words", "old_hashes").mapInArrow(_grow(min_words), f"doc_id {kind}, text_hash bigint, first int, last int")
    out = cut(runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")), "line-runs")
    for done in (met, first, pairs, table):
        drop_cut(done)
    return out


def dedup_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """docs with its text without later repeated runs, and n_lines and n_removed of the text's lines.

    Null texts stay null with 0 lines; texts without a repeated run are untouched.
    Rows equal in id and text are one text and treated alike. An empty table gives an
    empty result; other columns are passed on, but for older ones of the added names.
    """
    found = repeated_runs(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("runs").alias("_runs"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("_text_hash")).join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")  # grows with the corpus: never broadcast
    lines = F.split("text", "\n", -1)
    stays = F.filter(lines, lambda x, i: ~F.exists("_runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    return joined.withColumn("_kept", F.when(F.col("_runs").isNotNull(), F.struct(F.array_join(stays, "\n").alias("text"), F.size(stays).alias("n")))).select(
        *[F.coalesce("_kept.text", F.col("text")).alias("text") if n == "text" else F.col(f"`{n}`") for n in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("_runs").isNull(), 0).otherwise(F.size(lines) - F.col("_kept.n")).alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the runs of lines that stand in an earlier one; see dedup_lines."""
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
