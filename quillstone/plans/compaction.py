"""Compaction of a session into a target: what stays verbatim, what is summarized and in how much room."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.render import in_order
from quillstone.operators.extraction import literals, missing_literals
from quillstone.operators.log import greedy_windows
from quillstone.plans.compile import state_section
from quillstone.plans.package import allocate


def compaction_plan(log: DataFrame, target: int, cost: Column | None = None) -> DataFrame:
    """Per session: input_tokens, fits, split, recent_tokens, summary_tokens.

    A session of at most ``target`` tokens stays as it is (split 0, no summary). Of
    another the records from ``split`` on stay, the longest run of last ones that fits
    the share of recent records; those before get the rest of the target as a summary.
    Where not even the last record fits, split is behind it. A null payload costs 3.
    The running sum orders a session's costs only, its payloads are not shuffled.
    """
    recent, summary = allocate(target)
    costs = log.select("session_id", "seq", (T.word_count(F.col("payload")) + 3 if cost is None else cost).cast("bigint").alias("cost"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    held = costs.withColumn("stays", F.sum("cost").over(newest) <= recent)
    sums = held.groupBy("session_id").agg(F.sum("cost").alias("input_tokens"), F.coalesce(F.min(F.when(F.col("stays"), F.col("seq"))), F.max("seq") + 1).cast("bigint").alias("start"), F.coalesce(F.sum(F.when(F.col("stays"), F.col("cost"))), F.lit(0)).alias("kept"))
    fits = F.col("input_tokens") <= target
    return sums.select(
        "session_id",
        "input_tokens",
        fits.alias("fits"),
        F.when(fits, 0).otherwise(F.col("start")).cast("bigint").alias("split"),
        F.when(fits, F.col("input_tokens")).otherwise(F.col("kept")).alias("recent_tokens"),
        F.when(fits, 0).otherwise(summary).cast("bigint").alias("summary_tokens"),
    )


def history_chunks(log: DataFrame, limit: int) -> DataFrame:
    """session_id, seq, chunk: the history in chunks of at most ``limit`` words; a record that alone is longer is its own chunk."""
    return greedy_windows(log, T.word_count(F.col("payload")), limit).withColumnRenamed("window", "chunk")


def drop_recent(rows: DataFrame, target: int, by: str = "session_id") -> DataFrame:
    """rows(by, seq, cost) without the oldest ones, until the costs fit the target."""
    newest = Window.partitionBy(by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum("cost").over(newest)).where(F.col("spent") <= target).drop("spent")


def summaries(log: DataFrame, limit: int, summarize: Callable[[str], str], combine: Callable[[list[str]], str] | None = None) -> DataFrame:
    """session_id, summary: one call for a history that fits ``limit`` words, else one for each chunk and one that combines them.

    A chunk is one group of at most ``limit`` words (or one record); only chunk
    summaries meet in a session's group.
    """
    chunked = log.join(history_chunks(log, limit), ["session_id", "seq"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: F.coalesce(x["payload"], F.lit(""))), "\n")
    parts = chunked.groupBy("session_id", "chunk").agg(text.alias("text"))

    def each(frames):
        for f in frames:
            yield f.assign(summary=[summarize(t) for t in f["text"]])[["session_id", "chunk", "summary"]]

    done = parts.mapInPandas(each, "session_id string, chunk bigint, summary string")
    held = done.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "summary"))), lambda x: x["summary"]).alias("parts"))
    join = combine or (lambda xs: summarize("\n".join(xs)))

    def whole(frames):
        for f in frames:
            yield f.assign(summary=[p[0] if len(p) == 1 else join(list(p)) for p in f["parts"]])[["session_id", "summary"]]

    return held.mapInPandas(whole, "session_id string, summary string")


def enforce(summaries: DataFrame, recent: DataFrame, target: int) -> DataFrame:
    """summaries(session_id, summary), recent(session_id, seq, cost) -> session_id, summary, from_seq, fallback: a compaction that fits.

    What does not fit gives way in order: the summary is cut to the words that are left;
    where nothing is left it goes, and the oldest recent records go until the rest fits.
    fallback names what was done, null if nothing.
    """
    cost = recent.groupBy("session_id").agg(F.sum("cost").alias("recent_cost"), F.min("seq").alias("first"))
    fitted = drop_recent(recent, target).groupBy("session_id").agg(F.min("seq").alias("fitting"))
    held = summaries.join(cost, "session_id", "full").join(fitted, "session_id", "left").withColumn("room", F.lit(target) - F.coalesce("recent_cost", F.lit(0)))
    size = F.coalesce(T.word_count(F.col("summary")), F.lit(0))
    cut = F.array_join(F.slice(T.words(F.col("summary")), F.lit(1), F.greatest(F.lit(0), F.col("room")).cast("int")), " ")
    fallback = F.when(F.col("room") < 0, "dropped_recent").when((F.col("room") == 0) & (size > 0), "dropped_summary").when(size > F.col("room"), "cut_summary")
    return held.select("session_id", F.when(size <= F.col("room"), F.col("summary")).when(F.col("room") > 0, cut).alias("summary"), F.when(F.col("room") < 0, F.col("fitting")).otherwise(F.col("first")).alias("from_seq"), fallback.alias("fallback"))


def with_ledger(compacted: DataFrame, missing: DataFrame, target: int, most: int = 80, heading: str = "EXACT VALUES") -> DataFrame:
    """compacted(session_id, summary, cost) with ledger: as many first of missing(session_id, n, value, label) as fit min(``most``, the room left) words with the heading."""
    line = F.concat(F.lit("- "), F.when(F.col("label") != "", F.concat("label", F.lit(": "))).otherwise(F.lit("")), F.col("value"))
    order = Window.partitionBy("session_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spent = missing.withColumn("line", line).withColumn("spent", F.sum(T.word_count(F.col("line"))).over(order) + len(heading.split()))
    room = compacted.select("session_id", F.least(F.lit(most), F.lit(target) - F.col("cost")).alias("room"))
    kept = spent.join(room, "session_id").where(F.col("spent") <= F.col("room"))
    ledger = kept.groupBy("session_id").agg(F.concat(F.lit(heading + "\n"), in_order(F.col("n"), F.col("line"))).alias("ledger"))
    return compacted.join(ledger, "session_id", "left")


def compact(log: DataFrame, target: int, summarize: Callable[[str], str], window: int = 4000, ledger: bool = False) -> DataFrame:
    """session_id, summary, from_seq, fallback, ledger: sessions that fit stay as they are (from_seq 0); of others the last records stay and what is before them is summarized."""
    plan = compaction_plan(log, target)
    split = log.join(plan.select("session_id", "fits", F.col("split").alias("_split")), "session_id")
    history, recent = split.where((F.col("seq") < F.col("_split")) & ~F.col("fits")), split.where((F.col("seq") >= F.col("_split")) & ~F.col("fits"))
    said = enforce(summaries(history, window, summarize), recent.select("session_id", "seq", (T.word_count(F.col("payload")) + 3).alias("cost")), target)
    whole = plan.where("fits").select("session_id", F.lit(None).cast("string").alias("summary"), F.lit(0).cast("bigint").alias("from_seq"), F.lit(None).cast("string").alias("fallback"))
    out = said.select("session_id", "summary", F.col("from_seq").cast("bigint").alias("from_seq"), "fallback").unionByName(whole)
    if not ledger:
        return out.withColumn("ledger", F.lit(None).cast("string"))
    kept = recent.select("session_id", "payload").unionByName(said.select("session_id", F.coalesce("summary", F.lit("")).alias("payload")))
    missing = missing_literals(literals(history), kept)
    used = recent.groupBy("session_id").agg(F.sum(T.word_count(F.col("payload")) + 3).alias("_cost"))
    costed = out.join(used, "session_id", "left").withColumn("cost", F.coalesce("_cost", F.lit(0)) + T.word_count(F.col("summary"))).drop("_cost")
    return with_ledger(costed, missing, target).drop("cost")


def hybrid(items: DataFrame, log: DataFrame, target: int, summarize: Callable[[str], str], share: float = 0.35, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """State first, as much as fits its share of the target with ``least`` left over; then the sessions compacted into the rest."""
    budget = min(int(target * share), target - least)
    if budget < 0:
        raise ValueError(f"a target of {target} leaves no {least} for the conversation")
    return state_section(items, budget), compact(log, target - budget, summarize)
