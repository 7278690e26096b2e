"""Rules that stored rows must keep, each a query for the rows that break it; unions of them are reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.canonical import content_hash


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """id, code of every rule that holds for a row, in one scan; a rule that is null does not hold."""
    each = F.explode(F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda x: x.isNotNull()))
    return rows.select(F.col("id").cast("string").alias("id"), each.alias("code"))


def distinct_list(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """evidence(id, content, content_hash, source_ids): content and sources there, sources distinct, the hash that of the NFC content."""
    return violations(
        evidence,
        {
            "empty_content": F.coalesce(F.col("content"), F.lit("")) == "",
            "no_sources": F.coalesce(F.size("source_ids"), F.lit(0)) <= 0,
            "blank_source": F.exists("source_ids", lambda s: F.coalesce(F.trim(s), F.lit("")) == ""),
            "repeated_source": ~distinct_list(F.col("source_ids")),
            "hash_mismatch": ~F.col("content_hash").eqNullSafe(content_hash(F.col("content"))),
        },
    )


def state_violations(items: DataFrame) -> DataFrame:
    """items(id, type, retention, sources, supersedes, related_ids, rationale, task_status, blocked_by)."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return violations(
        items,
        {
            "critical_without_source": (F.col("retention") == "critical") & none("sources"),
            "supersedes_itself": F.col("supersedes") == F.col("id"),
            "relates_to_itself": F.array_contains("related_ids", F.col("id")),
            "decision_without_rationale": (F.col("type") == "decision") & (F.coalesce(F.trim("rationale"), F.lit("")) == ""),
            "blocked_without_blocker": (F.col("task_status") == "blocked") & none("blocked_by"),
        },
    )


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """snapshots(id, parent_snapshot_id, active_message_ids, archived_message_ids, state_item_ids): lists distinct, active and archived apart, not its own parent."""
    return violations(
        snapshots,
        {
            "own_parent": F.col("parent_snapshot_id") == F.col("id"),
            "repeated_active": ~distinct_list(F.col("active_message_ids")),
            "repeated_archived": ~distinct_list(F.col("archived_message_ids")),
            "repeated_state": ~distinct_list(F.col("state_item_ids")),
            "active_and_archived": F.size(F.array_intersect("active_message_ids", "archived_message_ids")) > 0,
        },
    )


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unresolved(rows: DataFrame, column: str, target: DataFrame, key: str, code: str) -> DataFrame:
    """id, code of rows whose reference (or one of a list of them) is no key of target; null references are none."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    references = rows.select("id", value.alias("_ref")).where("_ref is not null")
    return references.join(target.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti").select(F.col("id").cast("string").alias("id"), F.lit(code).alias("code")).distinct()


def integrity_report(sessions: DataFrame, messages: DataFrame, items: DataFrame, evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """relation, id, code: primary, unique and foreign keys and the rules of all relations, which a table format does not enforce."""
    of = lambda name, found: found.select(F.lit(name).alias("relation"), "id", "code")
    key = lambda rows: repeated(rows, "id").select(F.col("id").cast("string").alias("id"), F.lit("repeated_id").alias("code"))
    places = repeated(messages, "session_id", "seq").select(F.concat_ws(":", "session_id", "seq").alias("id"), F.lit("repeated_place").alias("code"))
    parts = [of(n, key(d)) for n, d in (("sessions", sessions), ("messages", messages), ("items", items), ("evidence", evidence), ("snapshots", snapshots))]
    parts += [of(n, unresolved(d, "session_id", sessions, "id", "unknown_session")) for n, d in (("messages", messages), ("items", items), ("snapshots", snapshots))]
    parts += [
        of("messages", places),
        of("messages", unresolved(messages, "parent_id", messages, "id", "unknown_parent")),
        of("items", unresolved(items, "supersedes", items, "id", "unknown_superseded")),
        of("items", unresolved(items, "sources", evidence, "id", "unknown_source")),
        of("items", state_violations(items)),
        of("evidence", evidence_violations(evidence)),
        of("snapshots", unresolved(snapshots, "parent_snapshot_id", snapshots, "id", "unknown_parent")),
        of("snapshots", snapshot_violations(snapshots)),
    ]
    return _union(parts)


def table_counts(**tables: DataFrame) -> DataFrame:
    """relation, n of every table, an empty one too."""
    return _union([d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, d in tables.items()])


def refuse(found: DataFrame, what: str) -> None:
    """Raise if there is any violation, naming a few: a batch is written whole or not at all."""
    bad = found.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: " + ", ".join(f"{r['id']} {r['code']}" for r in bad))
