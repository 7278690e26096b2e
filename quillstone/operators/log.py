"""Reads of the append-only log, its integrity, and ordered folds over a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.sources.store import with_hash


def in_range(log: DataFrame, start: int, stop: int) -> DataFrame:
    if start < 0:
        raise ValueError("start must not be negative")
    return log.where((F.col("seq") >= start) & (F.col("seq") < stop))


def around(log: DataFrame, seq: int, before: int, after: int) -> DataFrame:
    return log.where(F.col("seq").between(seq - before, seq + after))


def session_sizes(log: DataFrame) -> DataFrame:
    """Per session: records, next position and bytes."""
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("records"), (F.max("seq") + 1).alias("next_seq"), F.sum(F.octet_length("payload")).alias("bytes"))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n records of each session; sequence numbers are dense, so their maximum decides and no session is sorted."""
    ends = log.groupBy("session_id").agg(F.max("seq").alias("last"))
    return log.join(ends, "session_id").where(F.col("seq") > F.col("last") - n).drop("last")


def verify(log: DataFrame) -> DataFrame:
    """Records whose hash is not that of their number, id, kind and payload, a missing one too, or whose number is not their place.

    Only a flag of each record is sorted, not its payload.
    """
    stored = log.select("session_id", "seq", "id", "kind", "payload", F.col("hash").alias("stored"))
    flagged = with_hash(stored).select("session_id", "seq", "id", (~F.col("stored").eqNullSafe(F.col("hash"))).alias("changed"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    return flagged.withColumn("place", place).where(F.col("changed") | ~F.col("seq").eqNullSafe(F.col("place"))).select("session_id", "seq", "id")


def recent_window(log: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """The longest run of last records of each session whose costs (words and 3 each) fit the budget."""
    order = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    held = log.withColumn("cost", T.word_count(F.col("payload")) + 3 if cost is None else cost).drop("payload", "hash")  # costs are sorted, not texts
    return held.withColumn("spent", F.sum("cost").over(order)).where(F.col("spent") <= budget)


def prefix_fit(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """The longest run of first rows of each group whose costs fit the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def greedy_windows(log: DataFrame, size: Column, limit: int) -> DataFrame:
    """Fill a window until the next record overflows it, then open another; a record that alone is too large gets its own.

    The rule resets, so it is a fold over a session's sizes in order: one pass over
    sorted partitions that carries a session, its window and how full that is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, window, used = None, 0, 0
        for batch in batches:
            out = []
            for s, n in zip(batch.column("session_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if s != session:
                    session, window, used = s, 0, 0
                if used and used + n > limit:
                    window, used = window + 1, 0
                used += n
                out.append(window)
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("seq"), pa.array(out, pa.int64())], names=["session_id", "seq", "window"])

    held = log.where("session_id is not null").select("session_id", F.col("seq").cast("bigint").alias("seq"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    return held.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, "session_id string, seq bigint, window bigint")


def segments(thread: DataFrame) -> DataFrame:
    """A segment opens at each record without a parent, and at a session's first."""
    order = Window.partitionBy("session_id").orderBy("seq")
    opens = F.col("parent_id").isNull() | (F.row_number().over(order) == 1)
    return thread.withColumn("opens", opens.cast("int")).withColumn("segment", F.sum("opens").over(order)).drop("opens")


def tool_pairs(events: DataFrame) -> DataFrame:
    """Calls and results of tools by call id: a result answers the call before it, a second one is unmatched."""
    w = Window.partitionBy("call_id").orderBy("position")
    before, after = F.lag("kind").over(w), F.lead("kind").over(w)
    matched = F.when(F.col("kind") == "tool_result", F.coalesce(before == "tool_call", F.lit(False))).otherwise(F.coalesce(after == "tool_result", F.lit(False)))
    return events.withColumn("matched", matched)


def repeated_ids(events: DataFrame) -> DataFrame:
    """events(position, source_id) with repeated: whether its id was seen further up."""
    first = events.where("source_id is not null").groupBy("source_id").agg(F.min("position").alias("first"))
    return events.join(first, "source_id", "left").withColumn("repeated", F.coalesce(F.col("position") > F.col("first"), F.lit(False))).drop("first")


def import_counters(events: DataFrame) -> DataFrame:
    """Events, distinct and missing ids, repeats, missing times and types of an import, in one aggregate."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("id").isNull()).alias("missing_ids"),
        (F.count("id") - F.count_distinct("id")).alias("duplicates"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_timestamps"),
        F.count_if(F.col("kind") == "other").alias("unknown_types"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def import_report(events: DataFrame, by: str = "session_id") -> DataFrame:
    """events(by, position, reason, type, source_id, time_text, timestamp) of imports -> one row of counters for each, with clean: nothing was lost or odd.

    An error row has a reason; ``unusable_times`` were given but told nothing.
    """
    good, none = F.col("reason").isNull(), F.col("source_id").isNull()
    counted = repeated_ids(events) if by is None else events.join(events.where("source_id is not null").groupBy(by, "source_id").agg(F.min("position").alias("first")), [by, "source_id"], "left")
    n = lambda c: F.count_if(c)
    out = counted.groupBy(by).agg(
        n(good).alias("events"),
        n(good & none).alias("missing_ids"),
        n(good & F.col("timestamp").isNull()).alias("missing_times"),
        n(good & F.col("timestamp").isNull() & F.col("time_text").isNotNull()).alias("unusable_times"),
        n(good & (F.col("position") > F.col("first"))).alias("duplicates"),
        n(F.col("reason") == "blank").alias("blank"),
        n(~good & (F.col("reason") != "blank")).alias("malformed"),
        n(good & (F.col("type") == "other")).alias("unknown_types"),
    )
    clean = F.lit(True)
    for c in ("missing_ids", "unusable_times", "duplicates", "malformed", "unknown_types"):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("clean", clean)


def samples(events: DataFrame, column: str, most: int = 20, by: str = "session_id") -> DataFrame:
    """by, values: the first ``most`` distinct values in order of their first place."""
    first = events.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.min("position").alias("at"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("at", column))
    kept = first.withColumn("n", place).where(F.col("n") <= most)
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(column).alias("v")))), lambda x: x["v"]).alias("values"))
