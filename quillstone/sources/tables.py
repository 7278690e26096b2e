"""The engine's tables, derived from the relational ones: archive, threads, state items, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.store import with_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, id, kind, payload, hash: one row for each turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat("role", F.lit("_message")).alias("kind"), F.col("text").alias("payload")
    )
    return with_hash(rows)


def thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive with parents: every third turn goes back two, the sixth starts a new tree."""
    turn = F.col("seq")
    back = F.when(turn.isin(0, 5), F.lit(None)).when(turn % 3 == 0, turn - 2).otherwise(turn - 1)
    return archive(spark, sf_dir).withColumn("parent_id", F.when(back.isNotNull(), F.concat_ws("-", "session_id", back)))


def state_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State items from events: a user is a session, a high value supersedes the item before of the same type."""
    e = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    n = F.col("event_id")
    return e.select(
        n.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.expr("case event_type when 'click' then 'fact' when 'error' then 'constraint' when 'purchase' then 'decision' when 'signup' then 'goal' else 'task' end").alias("type"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.when(n % 11 == 0, "rejected").when(n % 7 == 0, "superseded").otherwise("active").alias("status"),
        F.when(n % 13 == 0, "critical").when(n % 5 == 0, "ephemeral").otherwise("durable").alias("retention"),
        F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k")).alias("subject"),
        F.col("ts").alias("created_at"),
        F.when((F.col("event_type") == "purchase") & (n % 2 == 0), F.concat(F.lit("paid "), "props")).alias("rationale"),
        F.when(F.col("value") > 40, before).cast("string").alias("supersedes"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from documents and labels: a strategy for each language, a budget by length."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = F.col("n_chars")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("scenario_id"),
        F.col("lang").alias("strategy"),
        F.when(size < 1000, 160).when(size < 4000, 900).otherwise(2000).alias("budget"),
        F.when(F.col("doc_id") % 10 == 0, "model_error").otherwise("success").alias("status"),
        (F.col("quality") == 1).alias("passed"),
        F.when(F.col("toxic") == 1, "fabricated").when(F.col("quality") == 1, "passed").otherwise("omitted").alias("completion"),
        F.when(F.col("quality") == 1, "fact").otherwise("constraint").alias("category"),
        (size / 4).cast("bigint").alias("context_tokens"),
        F.col("source").alias("model"),
    )
