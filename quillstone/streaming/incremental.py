"""Incremental import of the log as a stream, and event-time windows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.plugins import RateLimited


def pending(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Records of each session from its mark on, as a count: max(0, records - next_seq)."""
    sizes = log.groupBy("session_id").agg((F.max("seq") + 1).alias("records"))
    return sizes.join(marks, "session_id", "left").select("session_id", F.greatest(F.lit(0).cast("bigint"), F.col("records") - F.coalesce("next_seq", F.lit(0).cast("bigint"))).alias("pending"))


def advance(marks: DataFrame, batch: DataFrame) -> DataFrame:
    """New marks: they only go up, to one past the last record of the batch."""
    return marks.unionByName(batch.groupBy("session_id").agg((F.max("seq") + 1).alias("next_seq"))).groupBy("session_id").agg(F.max("next_seq").alias("next_seq"))


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Import new transcript files as they come; a batch writes its own folder, so a rerun of it replaces and never repeats.

    position is unique over all batches of up to 8192 partitions: the batch's number above the place inside it.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.select((F.lit(number << 46) + F.monotonically_increasing_id()).alias("position"), "line")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines = spark.readStream.text(path).select(F.col("value").alias("line"))
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; as a stream, rows later than the watermark are left out."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


Extractor = Callable[[list[dict], list[dict]], list[dict] | None]


def extract_new(log: DataFrame, marks: DataFrame, known: DataFrame, extractor: Extractor, window: int | None = None) -> DataFrame:
    """session_id, next_seq, ok, items (JSON): what an extractor finds in each session's records from its mark on.

    The extractor gets records (dicts of seq, id, kind, payload, in order) and the items
    known so far (dicts), and returns new items, or None for a reply that could not be
    read: then the mark stays and the same records are read again. With ``window`` a
    session is read in windows of so many records, and each window is shown what those
    before it found; a window that fails ends the session's run. Sessions run apart from
    one another; one session's new records are one group, as the fold over them is sequential.
    """
    fresh = log.join(marks, "session_id", "left").where(F.col("seq") >= F.coalesce("next_seq", F.lit(0))).select("session_id", "seq", "id", "kind", "payload")
    held = known.groupBy("session_id").agg(F.collect_list(F.to_json(F.struct(*[c for c in known.columns if c != "session_id"]))).alias("known"))

    def run(key, records, state):
        rows = records.sort_values("seq")[["seq", "id", "kind", "payload"]].to_dict("records")
        before = [json.loads(x) for x in (state["known"].iloc[0] if len(state) else [])]
        found, end, ok = [], None, True
        size = window or max(1, len(rows))
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            got = extractor(part, before + found)
            if got is None:
                ok = False
                break
            found += got
            end = int(part[-1]["seq"]) + 1
        return pd.DataFrame([{"session_id": key[0], "next_seq": end, "ok": ok, "items": json.dumps(found, sort_keys=True)}]) if rows else pd.DataFrame(columns=["session_id", "next_seq", "ok", "items"])

    pairs = fresh.groupBy("session_id").cogroup(held.groupBy("session_id"))
    return pairs.applyInPandas(run, "session_id string, next_seq bigint, ok boolean, items string")


def retrying(call: Callable, times: int = 3, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again up to ``times`` after a RateLimited, waiting what it names but at most ``longest`` seconds."""

    def run(*args):
        for attempt in range(times + 1):
            try:
                return call(*args)
            except RateLimited as e:
                if attempt == times:
                    raise
                sleep(min(longest, e.wait if e.wait is not None else 2.0**attempt))

    return run


def merge_extracted(existing: DataFrame, incoming: DataFrame, conflicts: DataFrame) -> DataFrame:
    """existing and the incoming items of sessions without any conflict(session_id); a session with one keeps what it had."""
    clear = incoming.join(conflicts.select("session_id").distinct(), "session_id", "left_anti")
    return existing.unionByName(clear, allowMissingColumns=True)


def hook_event(text: Column) -> Column:
    """A hook's JSON as a struct of event, session_id, transcript_path, cwd, trigger; what is no JSON object is the empty event."""
    held = F.try_parse_json(text)
    names = {"event": "hook_event_name", "session_id": "session_id", "transcript_path": "transcript_path", "cwd": "cwd", "trigger": "trigger"}
    return F.struct(*[F.coalesce(F.try_variant_get(held, f"$.{path}", "string"), F.lit("")).alias(n) for n, path in names.items()])


def capture_reason(event: Column, bytes: Column, automatic: bool = True, manual: bool = False, least: int = 1) -> Column:
    """Why a hook's event calls for no package, by the first rule that holds; null if it does. ``bytes`` is the transcript's size, null if it is not there."""
    return (
        F.when(event["event"] != "PreCompact", F.concat(F.lit("not a compaction event ("), F.when(event["event"] == "", "unknown").otherwise(event["event"]), F.lit(")")))
        .when((event["trigger"] == "auto") & F.lit(not automatic), "automatic capture is disabled")
        .when((event["trigger"] != "auto") & F.lit(not manual), "requested by the user, not by pressure")
        .when(event["transcript_path"] == "", "the event named no transcript")
        .when(bytes.isNull(), "the transcript is not there")
        .when(bytes < least, "the transcript is below the floor")
    )


def resume(planned: DataFrame, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the planned cells that the results below path lack, append theirs in one commit, and return all results."""
    spark = planned.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    left = planned.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if there else planned
    run(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
