"""Extracted items: grounding, citations, exact values, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: Fixed value: an exact value; an address with or without a port, a version or decimal, a hexadecimal or a plain number.
VALUE = r"(?<![\w.])(?:\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?|\d+(?:\.\d+)+|0[xX][0-9a-fA-F]+|\d[\d,_]*)(?!\w)(?!\.\d)"
#: Words that describe no value.
FILLER = (
    "a an and are as at be been but by for from had has have in into is it its of on or that the then this to was were we you i they he she there here with "
    "set setting use using tried try after before when while so also both each earlier later now still just only again already then thing things one"
).split()
SENTENCE_END, LABEL = r"[.!?;:\n]", r"[A-Za-z][\w-]*"
#: Types of items that are extracted.
EXTRACTED = ("goal", "constraint", "fact", "decision", "task", "open_question", "entity")


def findings(items: DataFrame, log: DataFrame, least: float = 0.34) -> DataFrame:
    """items(id, session_id, content, cited) -> id, severity, code: citations outside the session's log, or whose text does not ground the item."""
    ends = log.groupBy("session_id").agg(F.max("seq").alias("last"))
    cited = items.join(ends, "session_id", "left").join(log.select("session_id", F.col("seq").alias("cited"), "payload"), ["session_id", "cited"], "left")
    code = F.when(F.col("cited").isNull(), "unattributed").when(F.col("last").isNull() | (F.col("cited") < 0) | (F.col("cited") > F.col("last")), "out_of_range").when(F.col("payload").isNull(), "dangling_citation")
    weak = F.when(T.overlap(F.col("content"), F.col("payload")) < least, "weak_grounding")
    found = cited.withColumn("code", F.coalesce(code, weak)).where("code is not null")
    return found.select("id", F.when(F.col("code") == "weak_grounding", "warning").otherwise("error").alias("severity"), "code")


def item_findings(items: DataFrame, known: DataFrame, session_id: Column | None = None) -> DataFrame:
    """items(id, session_id, expected_session, type, rationale, supersedes) -> id, severity, code: wrong sessions, decisions without a reason, claims on unknown items, and sessions whose every item is superseded by another one."""
    of = lambda rows, severity, code: rows.select("id", F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    there = known.select(F.col("id").alias("supersedes")).unionByName(items.select(F.col("id").alias("supersedes"))).distinct()
    gone = items.where("supersedes is not null").select("session_id", F.col("supersedes").alias("id")).distinct().withColumn("gone", F.lit(True))
    whole = items.join(gone, ["session_id", "id"], "left").groupBy("session_id").agg(F.bool_and(F.col("gone").isNotNull()).alias("all_gone"), F.min("id").alias("id")).where("all_gone")
    return (
        of(items.where(~F.col("session_id").eqNullSafe(F.col("expected_session"))), "error", "wrong_session")
        .unionByName(of(items.where((F.col("type") == "decision") & (F.coalesce(F.trim("rationale"), F.lit("")) == "")), "error", "decision_without_rationale"))
        .unionByName(of(items.where("supersedes is not null").join(there, "supersedes", "left_anti"), "error", "supersedes_unknown_item"))
        .unionByName(of(whole, "warning", "everything_superseded"))
    )


def _trimmed(words: Column) -> Column:
    """Words without the filler at the end; then the last three, without the filler at their start."""
    says = lambda w: ~F.lower(w).isin(FILLER)
    last_of = lambda ws: F.coalesce(F.array_max(F.transform(ws, lambda w, i: F.when(says(w), i + 1).otherwise(0))), F.lit(0))
    first_of = lambda ws: F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(says(w), i + 1)), lambda i: i.isNotNull()))
    from_first = lambda ws: T.let(first_of(ws), lambda first: F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(ws, F.coalesce(first, F.lit(1)), 3)))
    return T.let(words, lambda ws: T.let(last_of(ws), lambda last: T.let(F.slice(ws, F.greatest(F.lit(1), last - 2), F.least(F.lit(3), last)), from_first)))


def label(before: Column, after: Column) -> Column:
    """What a value is of: up to three words before it in its sentence (90 characters) and the unit after it (14 characters), without filler."""
    left = F.element_at(F.split(F.right(before, F.lit(90)), SENTENCE_END), -1)
    head = F.array_join(_trimmed(F.regexp_extract_all(left, F.lit(LABEL), F.lit(0))), " ")
    right = F.element_at(F.split(F.left(after, F.lit(14)), SENTENCE_END), 1)
    unit = T.let(F.regexp_extract(right, LABEL, 0), lambda u: F.when(F.lower(u).isin(FILLER) | (F.length(u) > 12), "").otherwise(u))
    both = lambda h, u: F.when((h != "") & (u != ""), F.concat(h, F.lit(" ("), u, F.lit(")"))).when(h != "", h).otherwise(u)
    return T.let(head, lambda h: T.let(unit, lambda u: both(h, u)))


def stated(log: DataFrame) -> DataFrame:
    """session_id, seq, at, value, label of every exact value of every payload; 0, 1 and 2 say nothing and are left out."""
    found = F.regexp_extract_all("payload", F.lit(VALUE), F.lit(0))
    # split at the values: the text before and after each is what lies around its place
    around = F.split("payload", VALUE, -1)
    held = log.where(F.size(found) > 0).select("session_id", "seq", around.alias("parts"), F.posexplode(found).alias("at", "value"), found.alias("found"))
    ahead = F.concat(F.element_at("parts", F.col("at") + 2), F.coalesce(F.try_element_at("found", F.col("at") + 2), F.lit("")), F.coalesce(F.try_element_at("parts", F.col("at") + 3), F.lit("")))
    back = F.concat(F.coalesce(F.get("parts", F.col("at") - 1), F.lit("")), F.coalesce(F.get("found", F.col("at") - 1), F.lit("")), F.element_at("parts", F.col("at") + 1))
    return held.where(~F.col("value").isin("0", "1", "2")).select("session_id", "seq", "at", "value", label(back, ahead).alias("label"))


def literals(log: DataFrame, most: int = 24) -> DataFrame:
    """Exact values of each session with the words that describe them, the first described place of each, at most ``most`` of them."""
    first = stated(log).where("label <> ''").groupBy("session_id", "value").agg(F.min(F.struct("seq", "at", "label")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("first"))
    return first.withColumn("n", rank).where(F.col("n") <= most).select("session_id", "value", F.col("first.label").alias("label"), F.col("first.seq").alias("seq"), "n")


def missing_literals(ledger: DataFrame, kept: DataFrame) -> DataFrame:
    """Values of the ledger that no kept record of the session states: as a whole, not inside a longer word or number."""
    texts = kept.select("session_id", "payload")
    bounded = F.concat(F.lit(r"(?<![\w.])\Q"), F.col("value"), F.lit(r"\E(?![\w.])"))
    stated_ = ledger.select("session_id", "value").join(texts, "session_id").where(F.contains("payload", F.col("value")) & F.regexp("payload", bounded)).select("session_id", "value").distinct()
    return ledger.join(stated_, ["session_id", "value"], "left_anti")


def parse_items(replies: DataFrame, log: DataFrame) -> DataFrame:
    """replies(reply_id, session_id, text) -> reply_id, session_id, n, and an item's fields or the reason why it is rejected, the first that holds.

    A reply is a JSON object with a list ``items``; a reply that is not becomes one row
    with reason malformed_response. Cited ids that the session's log does not hold are dropped.
    """
    from quillstone.functions.parse import json_object, status_of, strip_fence, strip_reasoning

    held = replies.withColumn("v", json_object(strip_fence(strip_reasoning(F.col("text"))))).withColumn("items", F.try_variant_get("v", "$.items", "array<variant>"))
    bad = held.where("items is null").select("reply_id", "session_id", F.lit(0).alias("n"), F.lit("malformed_response").alias("reason"))
    each = held.where("items is not null").select("reply_id", "session_id", F.posexplode("items").alias("n", "r"))
    get = lambda name, kind="string": F.try_variant_get("r", f"$.{name}", kind)
    wanted = each.select("reply_id", "session_id", "n", F.explode(F.array_distinct(F.coalesce(get("source_ids", "array<string>"), F.array().cast("array<string>")))).alias("id"))
    there = wanted.join(log.select("session_id", "id", "seq"), ["session_id", "id"]).groupBy("reply_id", "n").agg(F.array_sort(F.collect_set("id")).alias("cited"), F.array_sort(F.collect_set("seq")).alias("seqs"))
    kind, content, reason_why = F.lower(F.trim(F.coalesce(get("type"), F.lit("")))), F.trim(F.coalesce(get("content"), F.lit(""))), F.trim(F.coalesce(get("rationale"), F.lit("")))
    joined = each.join(there, ["reply_id", "n"], "left")
    reason = (
        F.when(~F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")), "not_an_object").when(content == "", "no_content").when(~kind.isin(*EXTRACTED), "unknown_type").when(F.col("cited").isNull(), "unattributed").when((kind == "decision") & (reason_why == ""), "decision_without_rationale")
    )
    confidence = F.when(F.schema_of_variant(get("confidence", "variant")).isin("BOOLEAN"), 0.5).otherwise(T.unit(get("confidence")))
    known = ("active", "superseded", "rejected", "completed", "uncertain")
    out = joined.select("reply_id", "session_id", "n", reason.alias("reason"), kind.alias("type"), content.alias("content"), F.nullif(reason_why, F.lit("")).alias("rationale"), status_of(get("status"), known, "active").alias("status"), confidence.alias("confidence"), F.nullif(F.trim(F.coalesce(get("supersedes_content"), F.lit(""))), F.lit("")).alias("supersedes_content"), "cited", "seqs")
    return out.unionByName(bad, allowMissingColumns=True)


def extraction_report(parsed: DataFrame, most: int = 10) -> DataFrame:
    """reply_id -> emitted, accepted, rejected, unattributed, unknown_types, malformed and the first ``most`` reasons."""
    ok, bad = F.col("reason").isNull(), F.col("reason") == "malformed_response"
    reasons = F.slice(F.array_sort(F.collect_list(F.when(~ok & ~bad, F.struct("n", "reason")))), 1, most)
    return parsed.groupBy("reply_id").agg(
        F.count_if(~F.coalesce(bad, F.lit(False))).alias("emitted"), F.count_if(ok).alias("accepted"), F.count_if(~ok & ~bad).alias("rejected"), F.count_if(F.col("reason") == "unattributed").alias("unattributed"), F.count_if(F.col("reason") == "unknown_type").alias("unknown_types"), F.bool_or(F.coalesce(bad, F.lit(False))).alias("malformed"), reasons.alias("reasons")
    )


def verdict(text: Column) -> Column:
    """YES or NO from the first non-blank line without marks, else null."""
    first = F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    word = F.upper(F.regexp_replace(first, r"[^A-Za-z]", ""))
    return F.when(word.isin("YES", "NO"), word)


def token_total(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of tokens added up: exact only if all are, the method if they agree, else mixed."""
    method = F.when(F.count_distinct("method") == 1, F.min("method")).otherwise("mixed")
    return rows.groupBy(*by).agg(F.sum("count").alias("count"), F.bool_and("exact").alias("exact"), method.alias("method"))
