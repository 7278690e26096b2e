"""Packages: evidence, archive reference, review and validation rules, requests of targets, shares of a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of text that reads like an instruction.
INSTRUCTIONS = (
    r"ignore (all |any |the )?(previous|prior|above|earlier)",
    r"disregard (all |any |the )?(previous|prior|above|earlier)",
    r"\byou are now\b",
    r"\bnew (system )?(instructions?|prompt)\b",
    r"</?(system|instructions?)>",
    r"\b(rm|del|drop)\s+(-rf?\s+|table\s+)",
    r"\bcurl\b.{0,40}\|\s*(sh|bash)",
)
def evidence_links(items: DataFrame, log: DataFrame) -> DataFrame:
    """items(id, source) with the position of their record; of a repeated record id the last counts, an unknown one gives null."""
    places = log.groupBy(F.col("id").alias("source")).agg(F.max("seq").alias("seq"))
    return items.join(places, "source", "left")


def archive_reference(log: DataFrame, cited: DataFrame) -> DataFrame:
    """session_id, first_seq, last_seq, records of each session's log, and record_hashes: seq and hash of the records that cited(session_id, seq) names.

    Of the log only sequence numbers and the cited hashes are shuffled; what a package
    cites is bounded by its evidence.
    """
    whole = log.groupBy("session_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("records"))
    held = log.select("session_id", "seq", "hash").join(cited.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_semi")
    hashes = held.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("seq", "hash")))).alias("record_hashes"))
    return whole.join(hashes, "session_id", "left").withColumn("record_hashes", F.coalesce("record_hashes", F.create_map().cast("map<bigint,string>")))


def review(items: DataFrame, longest: int = 20_000) -> DataFrame:
    """Findings on items(id, content): instruction-shaped text (the first shape that fits) and oversized content."""
    hit = F.coalesce(*[F.when(F.col("content").rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(INSTRUCTIONS)])
    shaped = items.withColumn("shape", hit).where("shape is not null").select("id", F.lit("instruction_like").alias("code"), "shape")
    return shaped.unionByName(items.where(F.length("content") > longest).select("id", F.lit("oversized_item").alias("code"), F.lit(None).cast("int").alias("shape")))


def untraced(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, code of items that no evidence(item_id, seqs) with a position describes: nothing they say can be checked."""
    traced = evidence.where(F.size("seqs") > 0).select(F.col("item_id").alias("id")).distinct()
    return items.join(traced, "id", "left_anti").select("id", F.lit("unverified_content").alias("code"), F.lit(None).cast("int").alias("shape"))


def absolute_locations(references: DataFrame) -> DataFrame:
    """id, code of archive references(id, location) that name a path of the machine that built them."""
    return references.where(F.startswith("location", F.lit("/"))).select("id", F.lit("absolute_path").alias("code"), F.lit(None).cast("int").alias("shape"))


def validate(packages: DataFrame, items: DataFrame, evidence: DataFrame, log: DataFrame | None = None, version: int = 1, state_version: int = 1) -> DataFrame:
    """severity, code, package_id, id: what is wrong with packages, errors first by severity.

    packages(package_id, session_id, format_version, state_version, content_hash, expected_hash,
    archive_session_id, record_hashes), items(package_id, id, session_id, status, supersedes),
    evidence(package_id, item_id, seqs). With a log the cited records are checked too.
    """

    def of(rows: DataFrame, severity: str, code: str, id: str | None = None) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "package_id", (F.col(id).cast("string") if id else F.lit(None).cast("string")).alias("id"))

    own = items.select("package_id", F.col("id").alias("item_id"))
    with_session = items.withColumnRenamed("session_id", "own").join(packages.select("package_id", "session_id"), "package_id")
    claims = items.where("supersedes is not null").select("package_id", "id", F.col("supersedes").alias("item_id"))
    found = [
        of(packages.where(F.col("format_version") > version), "error", "unreadable_version"),
        of(packages.where(F.col("state_version") > state_version), "error", "unreadable_state_schema"),
        of(packages.where(~F.col("content_hash").eqNullSafe(F.col("expected_hash"))), "error", "hash_mismatch"),
        of(items.groupBy("package_id", "id").count().where("count > 1"), "error", "duplicate_state", "id"),
        of(with_session.where("own <> session_id"), "error", "foreign_state", "id"),
        of(items.where("status = 'superseded'"), "error", "superseded_included", "id"),
        of(evidence.join(own, ["package_id", "item_id"], "left_anti"), "error", "orphan_evidence", "item_id"),
        of(own.join(evidence, ["package_id", "item_id"], "left_anti").distinct(), "warning", "state_without_evidence", "item_id"),
        of(evidence.where(F.coalesce(F.size("seqs"), F.lit(0)) <= 0), "warning", "unresolvable_provenance", "item_id"),
        of(claims.join(own, ["package_id", "item_id"], "left_anti"), "warning", "supersedes_absent", "id"),
        of(packages.where("record_hashes is null"), "warning", "no_archive_reference"),
    ]
    if log is not None:
        named = packages.where("record_hashes is not null")
        cited = named.select("package_id", F.col("archive_session_id").alias("session_id"), F.explode("record_hashes").alias("seq", "expected"))
        against = cited.join(log.select("session_id", "seq", "hash", F.lit(True).alias("there")), ["session_id", "seq"], "left")
        shown = evidence.select("package_id", F.explode("seqs").alias("seq")).join(packages.select("package_id", "session_id"), "package_id")
        found += [
            of(named.where(~F.col("archive_session_id").eqNullSafe(F.col("session_id"))), "error", "archive_session_mismatch"),
            of(against.where("there is null"), "error", "cited_record_missing", "seq"),
            of(against.where(F.col("there") & ~F.col("hash").eqNullSafe(F.col("expected"))), "error", "cited_record_changed", "seq"),
            of(shown.join(log.select("session_id", "seq"), ["session_id", "seq"], "left_anti").distinct(), "warning", "evidence_outside_archive", "seq"),
        ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def report(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """package_id, errors, warnings, valid for every package."""
    counts = findings.groupBy("package_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    held = packages.select("package_id").join(counts, "package_id", "left")
    return held.select("package_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("errors", "warnings")]).withColumn("valid", F.col("errors") == 0)


def ordered(findings: DataFrame) -> DataFrame:
    """Errors before warnings, then by package, code and id."""
    return findings.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "package_id", "code", "id")


def render(sections: DataFrame, target: str) -> DataFrame:
    """sections(package_id, rank, section, text) -> package_id, body: the request of a target as JSON; an unknown target is generic."""
    whole = F.array_sort(F.collect_list(F.struct("rank", "section", "text")))
    held = sections.groupBy("package_id").agg(whole.alias("s"))
    system = F.array_join(F.transform(F.filter("s", lambda x: x["section"] != "task"), lambda x: x["text"]), "\n\n")
    task = F.array_join(F.transform(F.filter("s", lambda x: x["section"] == "task"), lambda x: x["text"]), "\n\n")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.struct(F.array(message("system", system), message("user", task)).alias("messages"))
    part = lambda text: F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    bodies = {
        "openai": chat,
        "local": chat,
        "anthropic": F.struct(system.alias("system"), F.array(message("user", task)).alias("messages")),
        "gemini": F.struct(part(system).alias("system_instruction"), F.array(part(task)).alias("contents")),
    }
    return held.select("package_id", F.to_json(bodies.get(target, F.struct(system.alias("context"), task.alias("task")))).alias("body"))


def allocate(target: int, recent_share: float = 0.4, least: int = 50) -> tuple[int, int]:
    """Tokens for recent turns and for the summary; a target under ``least`` cannot be split."""
    if target < least:
        raise ValueError(f"a target of {target} is under {least}")
    recent = max(1, int(target * recent_share))
    return recent, target - recent
