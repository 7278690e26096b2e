"""Identifiers: what is one, and those made from data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an id may start with.
PREFIXES = ("msg", "ses", "ev", "snap", "ctx", "goal", "con", "fact", "dec", "task", "oq", "pref", "ent", "evt", "art")


def is_valid(value: Column, prefix: str | None = None) -> Column:
    """Whether a value is an id: a known prefix (or the one given), an underscore and 24 hexadecimal digits. Null is none."""
    known = F.substring_index(value, "_", 1).isin(*([prefix] if prefix else PREFIXES))
    return F.coalesce(value.rlike(r"\A[a-z]+_[0-9a-f]{24}\z") & known, F.lit(False))


def is_reference(value: Column) -> Column:
    """Whether a value can stand as a reference: not null and not blank."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def short_hash(value: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(value, 256), 1, size)


def synthetic_id(source_key: Column, position: Column) -> Column:
    """The id of an event that came without one: the hash of its source and its position in 8 digits or more."""
    digits = position.cast("string")
    return F.concat(F.lit("synth-"), short_hash(source_key), F.lit("-"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def session_id_for(source_key: Column) -> Column:
    return F.concat(F.lit("ses_"), short_hash(source_key))


def run_id(*parts: Column) -> Column:
    """One id for the same values of all parts; null parts count as empty."""
    return F.concat(F.lit("run_"), short_hash(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x1f")))
