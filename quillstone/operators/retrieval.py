"""Lexical top-k over the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.render import content_of


def allowed(log: DataFrame, kinds: list[str] | None = None, first: int | None = None, last: int | None = None, types: list[str] | None = None, tools: list[str] | None = None) -> DataFrame:
    """Records that a filter allows: bounds count in, an empty list is no filter; event types and tool names are read from JSON payloads."""
    if kinds:
        log = log.where(F.col("kind").isin(kinds))
    if first is not None:
        log = log.where(F.col("seq") >= first)
    if last is not None:
        log = log.where(F.col("seq") <= last)
    for name, wanted in (("type", types), ("tool_name", tools)):
        if wanted:
            log = log.where(F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", "string").isin(wanted))
    return log


def search(log: DataFrame, query: str, limit: int, kinds: list[str] | None = None, first: int | None = None, last: int | None = None, types: list[str] | None = None, tools: list[str] | None = None, per: str | None = None, scorer: Callable[[Column, list[str]], Column] = T.score) -> DataFrame:
    """The best records for the query: filters first, then the score, ties to the earlier record; excerpts only of the hits.

    ``per`` names a column whose every value gets its own ``limit`` records. ``scorer``
    maps the tokens of a record and the terms to a score; 0 is no hit.
    """
    terms = T.query_terms(query)
    if not terms:
        return log.limit(0).select("session_id", "seq", "id", F.lit(0.0).alias("score"), F.lit("").alias("excerpt"))
    said = content_of(F.col("payload"))
    scored = allowed(log, kinds, first, last, types, tools).withColumn("said", said).where("said <> ''").withColumn("score", F.round(scorer(T.tokens(F.col("said")), terms), 9)).where("score > 0")
    if per is None:
        hits = scored.orderBy(F.desc("score"), "seq", "session_id").limit(limit)
    else:
        place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("score"), "seq"))
        hits = scored.withColumn("place", place).where(F.col("place") <= limit)
    return hits.select("session_id", "seq", "id", "score", T.excerpt(F.col("said"), terms).alias("excerpt"))
