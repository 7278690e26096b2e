"""Threads over parent pointers: the live branch of every tree, what was abandoned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.staging import dropped, staged


def _ancestors(nodes: DataFrame, max_rounds: int) -> DataFrame:
    """id, root for every node, by pointer doubling; a parent that is not there makes a root."""
    ids = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    now = staged(nodes.join(ids, "parent_id", "left").select("id", F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("id")).alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(ahead, "root").select("id", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
        still = after.where("moved").limit(1).count()
        dropped(now)
        now = after
        if not still:
            break
    else:
        raise ValueError(f"parents form a cycle or a line longer than 2^{max_rounds}")
    held = nodes.where("parent_id is not null").join(ids, "parent_id").select(F.col("id").alias("root"))
    if now.join(held, "root", "left_semi").limit(1).count():
        raise ValueError("parents form a cycle")
    return now.select("id", "root")


def live(thread: DataFrame, max_rounds: int = 24) -> DataFrame:
    """Records on the branch that ends at their tree's last record, and those without an id. All trees stay.

    Roots come from pointer doubling. A node is live if its tree's last node descends
    from it; descent is walked down from the leaves in rounds that double the reach as well.
    """
    first = thread.where("id is not null").groupBy("id").agg(F.min_by("parent_id", "seq").alias("parent_id"), F.min("seq").alias("seq"), F.max("seq").alias("last_seq"))
    roots = _ancestors(first.select("id", "parent_id"), max_rounds)
    leaves = first.join(roots, "id").groupBy("root").agg(F.max_by("id", F.struct("last_seq", "id")).alias("id"))
    jump = first.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    alive, jump = staged(leaves.select("id"), "alive"), staged(jump, "jump")
    reached = alive.count()
    for _ in range(max_rounds):
        alive = staged(alive.unionByName(alive.join(jump, "id").select(F.col("up").alias("id"))).distinct(), "alive")
        before, reached = reached, alive.count()
        if before == reached:
            break
        old = jump
        jump = staged(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select("id", F.col("upper").alias("up")), "jump")
        dropped(old)
    else:
        raise ValueError(f"a line is longer than 2^{max_rounds}")
    return thread.join(alive.withColumn("alive", F.lit(True)), "id", "left").where("alive or id is null").drop("alive")


def abandoned(thread: DataFrame) -> DataFrame:
    return thread.join(live(thread).select("session_id", "seq"), ["session_id", "seq"], "left_anti")


def nearest(thread: DataFrame, wanted: str, max_rounds: int = 24) -> DataFrame:
    """id, ancestor: the nearest record up the parents for which ``wanted`` (SQL) holds, or null.

    A record that is not wanted hands on to its parent; pointers over runs of such
    records double their reach each round.
    """
    nodes = thread.where("id is not null").groupBy("id").agg(F.min_by("parent_id", "seq").alias("parent_id"), F.min_by(F.expr(wanted), "seq").alias("wanted"))
    now = staged(nodes.select("id", F.col("parent_id").alias("ancestor")), "nearest")
    skip = staged(nodes.where("not wanted").select(F.col("id").alias("ancestor"), F.col("parent_id").alias("up")), "skips")
    for _ in range(max_rounds):
        after = staged(now.join(skip, "ancestor", "left").select("id", F.when(F.col("up").isNotNull(), F.col("up")).otherwise(F.col("ancestor")).alias("ancestor"), F.col("up").isNotNull().alias("moved")), "nearest")
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
        if skip.where("ancestor = up").limit(1).count():
            raise ValueError("parents form a cycle")
        further = skip.select(F.col("ancestor").alias("up"), F.col("up").alias("upper"))
        skip = staged(skip.join(further, "up", "left").select("ancestor", F.coalesce("upper", "up").alias("up")), "skips")
    there = nodes.where("wanted").select(F.col("id").alias("ancestor"), F.lit(True).alias("there"))
    return now.join(there, "ancestor", "left").select("id", F.when(F.col("there"), F.col("ancestor")).alias("ancestor"))
