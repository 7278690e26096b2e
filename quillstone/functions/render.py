"""Text of records, events, state and ledgers, as column expressions; grouped text is built per session or package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: The chat role of an event type; what is not listed speaks as the user.
ROLES = {"user_message": "user", "system_message": "system", "developer_message": "developer", "assistant_message": "assistant", "tool_call": "assistant", "tool_result": "tool"}
#: Types of state in the order in which they are rendered and kept, with their headings.
HEADINGS = {"goal": "GOALS", "constraint": "CONSTRAINTS", "fact": "FACTS", "decision": "DECISIONS", "task": "OPEN WORK", "open_question": "OPEN QUESTIONS", "entity": "ENTITIES"}
ORDER = tuple(HEADINGS)


def _field(payload: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "string")


def is_object(payload: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(payload)), F.lit("OBJECT")), F.lit(False))


def content_of(payload: Column) -> Column:
    """What a record says: a JSON object's first text, content or body that is not empty; any other payload is text itself."""
    first = F.coalesce(*[F.nullif(_field(payload, n), F.lit("")) for n in ("text", "content", "body")], F.lit(""))
    return F.when(is_object(payload), first).otherwise(F.coalesce(payload, F.lit("")))


def package_excerpt(payload: Column, most: int = 240) -> Column:
    """The first ``most`` characters, single-spaced, of a JSON object's first content, text or body that is not blank, or of a text payload."""
    held = F.coalesce(*[F.when(F.size(T.words(_field(payload, n))) > 0, _field(payload, n)) for n in ("content", "text", "body")], F.lit(""))
    return F.substring(T.collapsed(F.when(is_object(payload), held).otherwise(F.coalesce(payload, F.lit("")))), 1, most)


def label_of(kind: Column, tool_name: Column, source_type: Column) -> Column:
    """An event's tag: its type, with the tool's name, or with the source's own type for an event of type other."""
    named = F.coalesce(tool_name, F.lit("")) != ""
    other = (kind == "other") & (F.coalesce(source_type, F.lit("")) != "")
    return F.concat(kind, F.when(named, F.concat(F.lit(" name="), tool_name)).when(other, F.concat(F.lit(" type="), source_type)).otherwise(F.lit("")))


def body_of(text: Column, raw: Column) -> Column:
    """The event's text, an empty one too, else its raw record, else nothing."""
    return F.coalesce(text, raw, F.lit(""))


def rendered(kind: Column, tool_name: Column, source_type: Column, text: Column, raw: Column) -> Column:
    return F.concat(F.lit("["), label_of(kind, tool_name, source_type), F.lit("] "), body_of(text, raw))


def role_of(kind: Column) -> Column:
    """The chat role of an event type."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), kind), F.lit("user"))


def spoken(kind: Column, text: Column) -> Column:
    """Whether an event is a turn that somebody spoke: a message with a text that is not blank."""
    return kind.endswith("_message") & (F.size(T.words(text)) > 0)


def turn(kind: Column, text: Column, most: int = 1200) -> Column:
    """role and content of a recent turn, clipped to ``most`` characters."""
    clipped = F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(" […truncated]"))).otherwise(text)
    return F.struct(F.regexp_replace(kind, "_message$", "").alias("role"), clipped.alias("content"))


def in_order(order: Column, line: Column, between: str = "\n") -> Column:
    """An aggregate: the lines of a group, joined in order. For groups that a budget bounds."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), line.alias("line")))), lambda x: x["line"]), between)


def render_events(events: DataFrame, by: str) -> DataFrame:
    """events(by, position, type, tool_name, source_type, text, raw) -> by, text: one block of text of each group's events in order."""
    line = rendered(*[F.col(c) for c in ("type", "tool_name", "source_type", "text", "raw")])
    return events.groupBy(by).agg(in_order(F.col("position"), line).alias("text"))


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in ORDER]), kind)


def state_line(content: Column, rationale: Column) -> Column:
    return F.concat(F.lit("- "), content, F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(F.lit(" (because: "), rationale, F.lit(")"))).otherwise(F.lit("")))


def render_state(items: DataFrame, by: str = "session_id") -> DataFrame:
    """items(by, id, type, content, rationale, status, created_at) -> by, text: active items under their types' headings; types without a heading are left out."""
    active = items.where("status = 'active'").withColumn("rank", type_rank(F.col("type"))).where("rank > 0")
    block = in_order(F.struct("created_at", "id"), state_line(F.col("content"), F.col("rationale")))
    heading = F.element_at(F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair]), F.col("type"))
    blocks = active.groupBy(by, "type", "rank").agg(block.alias("lines")).select(by, "rank", F.concat(heading, F.lit("\n"), F.col("lines")).alias("block"))
    return blocks.groupBy(by).agg(in_order(F.col("rank"), F.col("block"), "\n\n").alias("text"))


def render_ledger(literals: DataFrame, heading: str = "EXACT VALUES", by: str = "session_id") -> DataFrame:
    """literals(by, n, value, label) -> by, text: one line for each value under the heading."""
    line = F.concat(F.lit("- "), F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.concat("label", F.lit(": "))).otherwise(F.lit("")), F.col("value"))
    return literals.groupBy(by).agg(F.concat(F.lit(heading + "\n"), in_order(F.col("n"), line)).alias("text"))
