"""Reading replies of a model: reasoning and fences off, the JSON object out, its fields checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_reasoning(text: Column) -> Column:
    """Text without <think> blocks; an opened block that never closes takes the rest along, a lone closing tag what is before it."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    headless = F.regexp_replace(closed, r"(?is)\A(?:(?!<think>).)*</think>", "")
    return F.trim(F.regexp_replace(headless, r"(?is)<think>.*\z", ""))


def strip_fence(text: Column) -> Column:
    """What stands inside a code fence that is the whole text, else the text, trimmed."""
    inner = F.regexp_extract(F.trim(text), r"(?s)\A```[A-Za-z0-9_-]*\s*\n(.*?)\n?```\z", 1)
    return F.when(F.trim(text).rlike(r"(?s)\A```[A-Za-z0-9_-]*\s*\n.*```\z"), F.trim(inner)).otherwise(F.trim(text))


def json_object(text: Column) -> Column:
    """The variant from the first brace to the last one; null if that is not a JSON object. Nothing is repaired."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    held = F.try_parse_json(F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1)))
    return F.when(F.startswith(F.schema_of_variant(held), F.lit("OBJECT")), held)


def structured(text: Column, required: dict[str, str]) -> Column:
    """Why a reply is no object with the required fields of the given types (as Spark names them); null if it is one."""
    held = json_object(strip_fence(strip_reasoning(text)))
    reason = F.when(held.isNull(), "not_an_object")
    for name, kind in required.items():
        value = F.try_variant_get(held, f"$.{name}", "variant")
        reason = reason.when(value.isNull() | F.is_variant_null(value), f"missing:{name}").when(~F.startswith(F.schema_of_variant(value), F.lit(kind)), f"type:{name}")
    return reason


def status_of(value: Column, known: tuple[str, ...], default: str) -> Column:
    """A value of the known ones, in lower case, else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).otherwise(F.lit(default))


def ratio(before: Column, after: Column, empty_is_infinite: bool = True) -> Column:
    """How many times smaller something became: 1 where both are 0; where only the second is 0 infinite, or null."""
    none = F.lit(float("inf")) if empty_is_infinite else F.lit(None).cast("double")
    return F.when(after != 0, before.cast("double") / after).when(before == 0, 1.0 if empty_is_infinite else None).otherwise(none)
