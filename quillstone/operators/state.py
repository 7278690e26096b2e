"""State items: what is current, supersession, conflicts, reconciliation, placement, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.sources.staging import dropped, staged


def current(items: DataFrame) -> DataFrame:
    """Items that are not rejected and that no item supersedes, whatever the session of that item."""
    gone = items.where("supersedes is not null").select(F.col("supersedes").alias("gone")).distinct()
    return items.where("status <> 'rejected'").join(gone, F.col("id") == F.col("gone"), "left_anti")


def successors(items: DataFrame) -> DataFrame:
    """Each superseded item with its first successor by time and id."""
    return items.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min(F.struct("created_at", "id"))["id"].alias("successor"))


def newest(items: DataFrame, max_rounds: int = 40) -> DataFrame:
    """id, newest, steps: the end of each item's chain of first successors, by pointer doubling.

    A round doubles the distance each pointer has gone, so a chain of a million items
    takes twenty joins; rounds are written out, a cycle ends with steps null.
    """
    next_of = successors(items).select("id", F.col("successor").alias("to"))
    now = staged(items.select("id").distinct().join(next_of, "id", "left").select("id", F.coalesce("to", "id").alias("newest"), F.col("to").isNotNull().cast("bigint").alias("steps")), "chain")
    for _ in range(max_rounds):
        ahead = now.select(F.col("id").alias("newest"), F.col("newest").alias("further"), F.col("steps").alias("more"))
        after = staged(now.join(ahead, "newest").select("id", F.col("further").alias("newest"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("further") != F.col("newest")).alias("moved")), "chain")
        moved = after.where("moved").limit(1).count()
        dropped(now)
        now = after
        if not moved:
            break
    now = now.select("id", "newest", "steps")
    return now.join(next_of.select(F.col("id").alias("newest"), F.lit(True).alias("open")), "newest", "left").select("id", "newest", F.when(F.col("open").isNull(), F.col("steps")).alias("steps"))


def duplicate_active(items: DataFrame) -> DataFrame:
    return items.where("status = 'active'").groupBy("session_id", "type", F.lower(F.trim("content")).alias("content")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def contradictory_facts(items: DataFrame) -> DataFrame:
    subject = F.lower(F.trim("subject"))
    facts = items.where("status = 'active' and type = 'fact'").withColumn("subject", subject).where("subject <> ''")
    return facts.groupBy("session_id", "subject").agg(F.count_distinct(F.lower(F.trim("content"))).alias("contents"), F.count(F.lit(1)).alias("n")).where("contents > 1")


def supersession_forks(items: DataFrame) -> DataFrame:
    """Items that two or more supersede, whatever their status."""
    return items.where("supersedes is not null").groupBy("supersedes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What each incoming item does: supersede the stored item that it claims to, be unchanged, or be added.

    incoming has ``claim``, the content that it says it replaces. Matches are by
    session, type and collapsed content; of stored items alike the last counts. A claim
    that only an incoming item meets is added; one that nothing meets is added and missing.
    """
    key = ["session_id", "mark"]
    known = existing.withColumn("mark", T.fingerprint(F.col("type"), F.col("content"))).groupBy(*key).agg(F.max(F.struct("created_at", "id"))["id"].alias("stored"))
    new = incoming.withColumn("claimed", F.when(F.trim(F.coalesce("claim", F.lit(""))) != "", F.col("claim")))
    new = new.withColumn("mark", T.fingerprint(F.col("type"), F.coalesce("claimed", "content")))
    arriving = incoming.select("session_id", T.fingerprint(F.col("type"), F.col("content")).alias("mark"), F.lit(True).alias("arrives")).distinct()
    met = new.join(known, key, "left").join(arriving, key, "left")
    claims, stored = F.col("claimed").isNotNull(), F.col("stored").isNotNull()
    action = F.when(claims & stored, "supersedes").when(claims & F.col("arrives"), "added").when(claims, "supersedes_missing").when(stored, "unchanged").otherwise("added")
    return met.select("session_id", "id", action.alias("action"), F.when(claims | stored, F.col("stored")).alias("target"))


def place(items: DataFrame) -> DataFrame:
    """Level of retention: what is critical is the project's, what is ephemeral the event's, then the type decides."""
    level = F.when(F.col("retention") == "critical", "project").when(F.col("retention") == "ephemeral", "event").when(F.col("type").isin("goal", "constraint", "decision"), "project").otherwise("session")
    return items.withColumn("level", level)


def carried_forward(items: DataFrame, project: str, session: str) -> DataFrame:
    """Project-level current items of the project's other sessions, the first of each fingerprint by session and time."""
    others = place(current(items)).where((F.col("project") == project) & (F.col("session_id") != session) & (F.col("level") == "project") & (F.col("status") == "active"))
    first = Window.partitionBy("mark").orderBy("session_id", "created_at", "id")
    return others.withColumn("mark", T.fingerprint(F.col("type"), F.col("content"))).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "mark")


def dangling(items: DataFrame) -> DataFrame:
    """References to items that do not exist."""
    ids = items.select(F.col("id").alias("there")).distinct()
    return items.where("supersedes is not null").join(ids, F.col("supersedes") == F.col("there"), "left_anti")


def cross_session(items: DataFrame) -> DataFrame:
    other = items.select(F.col("id").alias("there"), F.col("session_id").alias("other_session"))
    return items.join(other, F.col("supersedes") == F.col("there")).where("session_id <> other_session")


def listing(items: DataFrame, types: list[str] | None = None, status: str | None = None) -> DataFrame:
    """Items of the types (none of an empty list, all without one) and status."""
    if types is not None:
        items = items.where(F.col("type").isin(types)) if types else items.where(F.lit(False))
    return items if status is None else items.where(F.col("status") == status)


def lineage(snapshots: DataFrame, max_rounds: int = 40) -> DataFrame:
    """snapshots(id, parent_id) -> id, root, depth: the first snapshot of each line and the steps from it, by pointer doubling."""
    now = staged(snapshots.select("id", F.coalesce("parent_id", "id").alias("root"), F.col("parent_id").isNotNull().cast("bigint").alias("depth")), "lineage")
    for _ in range(max_rounds):
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        after = staged(now.join(ahead, "root").select("id", F.col("further").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("further") != F.col("root")).alias("moved")), "lineage")
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now
    raise ValueError(f"a line of snapshots does not end within 2^{max_rounds} steps: it runs in a circle")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each session by time and id."""
    return snapshots.groupBy("session_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def integrity(messages: DataFrame) -> DataFrame:
    """Violations in messages(id, session_id, seq, role, tool_name, parent_id): code and id, one row for each broken rule."""
    rules = {
        "negative_seq": F.col("seq") < 0,
        "own_parent": F.col("parent_id") == F.col("id"),
        "tool_without_name": (F.col("role") == "tool") & F.col("tool_name").isNull(),
        "name_without_tool": (F.col("role") != "tool") & F.col("tool_name").isNotNull(),
    }
    broken = messages.select("id", F.explode(F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(c)) for c, r in rules.items()]), lambda x: x.isNotNull())).alias("code"))
    again = messages.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("repeated_seq").alias("code"))
    return broken.unionByName(again)


def all_conflicts(items: DataFrame) -> DataFrame:
    """kind, session_id, key, n of repeated active items, contradictory facts and forks, in that order of rank."""
    none = F.lit(None).cast("string")
    one = duplicate_active(items).select(F.lit(1).alias("rank"), F.lit("duplicate_active").alias("kind"), "session_id", F.concat_ws(":", "type", "content").alias("key"), "n")
    two = contradictory_facts(items).select(F.lit(2).alias("rank"), F.lit("contradictory_facts").alias("kind"), "session_id", F.col("subject").alias("key"), "n")
    three = supersession_forks(items).select(F.lit(3).alias("rank"), F.lit("supersession_fork").alias("kind"), none.alias("session_id"), F.col("supersedes").alias("key"), "n")
    return one.unionByName(two).unionByName(three)


def listed(items: DataFrame, session_id: str, types: list[str], status: str | None = None) -> DataFrame:
    """Items of a session by time and id; no types, no rows."""
    held = items.where((F.col("session_id") == session_id) & F.col("type").isin(types))
    return (held if status is None else held.where(F.col("status") == status)).orderBy("created_at", "id")


def hydrated(items: DataFrame, references: DataFrame) -> DataFrame:
    """items(id) with sources: their references(id, ordinal, reference) in order, an empty list where there are none."""
    lists = references.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reference"))), lambda x: x["reference"]).alias("sources"))
    return items.join(lists, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


#: Columns of every state item; the others are attributes of its type.
BASE = ("id", "session_id", "type", "content", "status", "retention", "importance", "confidence", "trust", "created_at", "supersedes", "sources", "related_ids", "metadata", "blocked_by")


def to_row(items: DataFrame) -> DataFrame:
    """State items with their type's own columns as one JSON text, nulls left out."""
    own = [c for c in items.columns if c not in BASE]
    return items.select(*[c for c in items.columns if c in BASE], F.to_json(F.struct(*own)).alias("attributes") if own else F.lit("{}").alias("attributes"))


def from_row(rows: DataFrame, attributes: str) -> DataFrame:
    """The reverse of to_row, with the attributes' schema."""
    return rows.withColumn("_a", F.from_json("attributes", attributes)).select(*[c for c in rows.columns if c != "attributes"], "_a.*")


def insert(stored: DataFrame, batch: DataFrame, path: str, check: DataFrame) -> None:
    """Append a batch of rows to a table, or none of it: check(id, code) has its violations, ids must be new."""
    from quillstone.operators.integrity import refuse

    taken = batch.join(stored.select("id"), "id", "left_semi").select("id").unionByName(batch.groupBy("id").count().where("count > 1").select("id"))
    refuse(taken.select(F.col("id").cast("string").alias("id"), F.lit("repeated_id").alias("code")).unionByName(check), "the batch was not written")
    batch.write.mode("append").parquet(path)
