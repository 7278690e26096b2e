"""Finding transcripts, telling their format, and the survey of a session before it is imported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.render import spoken, turn
from quillstone.operators import thread as H
from quillstone.sources import jsonl

#: Record types of an agent transcript.
AGENT_TYPES = (
    "user assistant system attachment summary file-history-snapshot file-history-delta mode permission-mode ai-title custom-title agent-color "
    "agent-name last-prompt queue-operation bridge-session"
).split()


def sessions(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """path, modified, bytes of the transcripts one folder below root, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*")
    found = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "path")
    return found.limit(limit) if limit is not None else found


def sample_lines(spark: SparkSession, path: str, lines: int = 4, chars: int = 2_000_000) -> list[str]:
    """The first whole lines of a file, as many as ``lines`` and ``chars`` allow (one at least)."""
    out, held = [], 0
    for row in spark.read.text(path).limit(lines).collect():
        held += len(row[0])
        if out and held > chars:
            break
        out.append(row[0])
    return out


def _record(line: str):
    try:
        return json.loads(line)
    except ValueError:
        return None


def looks_generic(lines: list[str]) -> bool:
    """Whether the first line that is not blank is a JSON object, or begins like one that was cut."""
    first = next((x.strip() for x in lines if x.strip()), "")
    return isinstance(_record(first), dict) or (first.startswith("{") and _record(first) is None)


def looks_agent(lines: list[str]) -> bool:
    """Whether a line of a known type names its session; a line that is no object or of an unknown type says no, one that was cut says nothing."""
    for line in lines:
        record = _record(line) if line.strip() else None
        if record is None:
            continue
        if not isinstance(record, dict) or record.get("type") not in AGENT_TYPES:
            return False
        if "sessionId" in record:
            return True
    return False


#: Importers in the order in which they are asked: name, whether it reads the format, and (position, line) -> events.
IMPORTERS = [("agent", looks_agent, jsonl.agent_events), ("generic", looks_generic, jsonl.normalize)]


def importer_for(lines: list[str]) -> str:
    """The name of the first importer that knows the format; none is an error."""
    for name, knows, _ in IMPORTERS:
        if knows(lines):
            return name
    raise ValueError("no importer reads this format")


def events_of(spark: SparkSession, path: str, importer: str | None = None) -> DataFrame:
    """Events and located errors of one transcript."""
    name = importer or importer_for(sample_lines(spark, path))
    read = {n: f for n, _, f in IMPORTERS}[name]
    return read(jsonl.lines_of(spark, path))


def survey(events: DataFrame, tail: int = 12) -> DataFrame:
    """events(position, source_id, parent_id, type, text) -> position, source_id, turn: the last ``tail`` spoken turns of the live thread.

    The thread is told from identities alone; only the turns that are kept carry text.
    """
    nodes = events.select(F.lit("s").alias("session_id"), F.col("position").alias("seq"), F.nullif("source_id", F.lit("")).alias("id"), "parent_id")
    live = H.live(nodes).select(F.col("seq").alias("position"))
    said = events.where(spoken(F.col("type"), F.col("text"))).join(live.distinct(), "position", "left_semi")
    last = said.select("position").orderBy(F.desc("position")).limit(tail)
    return events.join(F.broadcast(last), "position").select("position", "source_id", turn(F.col("type"), F.col("text")).alias("turn")).orderBy("position")


def project_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths(path) with root: the longest of roots(root) that is the path or a folder above it, else the path itself."""
    above = paths.select("path", F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), n -> substring_index(path, '/', n))")).alias("root"))
    best = above.join(roots.distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left").select("path", F.coalesce("root", "path").alias("root"))
