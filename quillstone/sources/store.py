"""Writing and reading of the log, results, packages and incremental state. A log is Parquet by session; a batch is one append."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.canonical import canonical_json, record_hash
from quillstone.functions.ids import synthetic_id

LOG = "session_id string, seq bigint, id string, kind string, payload string, hash string"
VERSION = 1


def is_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()


def body(seq: Column, id: Column, kind: Column, payload: Column) -> Column:
    """Canonical JSON of a record without its hash. A payload that is JSON of an object or list stands as such, any other as a string."""
    nested = F.coalesce(payload.rlike(r"^\s*[\[{]"), F.lit(False)) & is_json(payload)
    held = F.when(payload.isNull(), F.lit("null")).when(nested, payload).otherwise(_quoted(payload))
    return canonical_json(F.concat(F.lit('{"id":'), _quoted(id), F.lit(',"kind":'), _quoted(kind), F.lit(',"payload":'), held, F.lit(',"seq":'), seq.cast("string"), F.lit("}")))


def _quoted(text: Column) -> Column:
    """A string as a JSON literal."""
    escaped = F.get_json_object(F.to_json(F.struct(F.array(text).alias("v"))), "$.v")
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(escaped, 2, F.length(escaped) - 2))


def with_hash(log: DataFrame) -> DataFrame:
    """A log with the hash of each record's sequence number, id, kind and payload."""
    return log.withColumn("hash", record_hash(body(F.col("seq"), F.col("id"), F.col("kind"), F.col("payload"))))


def record_lines(log: DataFrame) -> DataFrame:
    """session_id, seq, line: a record as one line of canonical JSON with its hash."""
    held = F.substring(body(F.col("seq"), F.col("id"), F.col("kind"), F.col("payload")), 2, 2**31 - 1)
    return log.select("session_id", "seq", F.concat(F.lit('{"hash":"'), "hash", F.lit('",'), held).alias("line"))


def numbered(batch: DataFrame, ends: DataFrame) -> DataFrame:
    """batch(session_id, position, ...) with seq: dense from each session's next number on, in order of position."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("position"))
    held = batch.withColumn("_place", place).join(ends.select("session_id", "next_seq"), "session_id", "left")
    return held.withColumn("seq", (F.coalesce("next_seq", F.lit(0)) + F.col("_place") - 1).cast("bigint")).drop("_place", "next_seq")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log below path; an empty one where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def next_numbers(log: DataFrame) -> DataFrame:
    """session_id, next_seq; sessions without a record are not there (0)."""
    return log.groupBy("session_id").agg((F.max("seq") + 1).alias("next_seq"))


def append(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Append batch(session_id, position, id, kind, payload) as one commit; returns the records written.

    Ids may repeat (a later record is a revision) but not be null. One writer at a
    time: sequence numbers go on from the log as it is read here.
    """
    if batch.where("id is null").limit(1).count():
        raise ValueError("a record without an id cannot be appended")
    rows = with_hash(numbered(batch, next_numbers(read_log(spark, path)))).select("session_id", "seq", "id", "kind", "payload", "hash")
    before = read_log(spark, path).count()
    rows.write.mode("append").parquet(path)
    return read_log(spark, path).count() - before


def append_one(spark: SparkSession, path: str, session_id: str, id: str, payload: str, kind: str = "message") -> int:
    return append(spark, path, spark.createDataFrame([(session_id, 0, id, kind, payload)], "session_id string, position bigint, id string, kind string, payload string"))


def import_rows(events: DataFrame, session_id: str, source_key: str) -> DataFrame:
    """events(position, source_id, type, payload) as a batch to append: an event without an id (or with an empty one) gets a synthetic one by its place among the events."""
    place = F.row_number().over(Window.partitionBy(F.lit(session_id)).orderBy("position")) - 1
    own = F.nullif(F.col("source_id"), F.lit(""))
    return events.select(F.lit(session_id).alias("session_id"), "position", F.coalesce(own, synthetic_id(F.lit(source_key), place)).alias("id"), F.col("type").alias("kind"), "payload")


def read_seq(log: DataFrame, session_id: str, seq: int) -> DataFrame:
    """One record, its hash checked; none there, or a hash that differs, is an error."""
    found = log.where((F.col("session_id") == session_id) & (F.col("seq") == seq))
    checked = with_hash(found.withColumnRenamed("hash", "stored")).select("hash", "stored").collect()
    if not checked:
        raise IndexError(f"{session_id} has no record {seq}")
    if any(r["hash"] != r["stored"] for r in checked):
        raise ValueError(f"record {seq} of {session_id} does not match its hash")
    return found


def complete_lines(lines: DataFrame) -> DataFrame:
    """lines(position, line) of a log file without a torn last line: one that does not parse. A damaged line further up stays and is reported by reads."""
    last = lines.agg(F.max("position").alias("last"))
    return lines.join(F.broadcast(last), lines["position"] == last["last"], "left").where(F.col("last").isNull() | is_json(F.col("line"))).drop("last")


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as JSON lines, null fields kept."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows; blank lines are skipped, a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_package(spark: SparkSession, package: dict, path: str) -> None:
    """One package, readable: indented JSON with sorted keys."""
    text = json.dumps(package, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_package(spark: SparkSession, path: str) -> dict:
    """A written package; what is no object, has no manifest or a newer version is refused."""
    rows = spark.read.text(path, wholetext=True).where("value <> ''").collect()
    try:
        package = json.loads(rows[0]["value"]) if rows else None
    except ValueError as e:
        raise ValueError("not a package: no JSON") from e
    if not isinstance(package, dict) or not isinstance(package.get("manifest"), dict):
        raise ValueError("not a package: no object with a manifest")
    version = package["manifest"].get("format_version")
    if not isinstance(version, int) or isinstance(version, bool) or version > VERSION:
        raise ValueError(f"package version {version!r} cannot be read")
    return package


def save_state(spark: SparkSession, folder: str, session_id: str, next_seq: int, items: list[dict]) -> str:
    """State and mark together, as one new version: a reader sees the last version that was written whole."""
    path = f"{folder}/{session_id}/v={next_seq:012d}-{uuid.uuid4().hex[:8]}"
    row = json.dumps({"version": VERSION, "session_id": session_id, "next_seq": next_seq, "items": items}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(path)
    return path


def load_state(spark: SparkSession, folder: str, session_id: str) -> tuple[int, list[dict]]:
    """(next_seq, items) of the newest version; anything missing, unreadable, of another version or session is the empty state, never an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{session_id}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return 0, []
    for path in sorted((str(s.getPath()) for s in fs.listStatus(fs_path)), reverse=True):
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            continue
        try:
            rows = spark.read.text(path, wholetext=True).where("value <> ''").collect()
            held = json.loads(rows[0]["value"]) if rows else None
        except ValueError:
            held = None
        good = isinstance(held, dict) and held.get("version") == VERSION and held.get("session_id") == session_id and isinstance(held.get("next_seq"), int) and isinstance(held.get("items"), list)
        return (held["next_seq"], held["items"]) if good and all(isinstance(i, dict) and i.get("id") for i in held["items"]) else (0, [])
    return 0, []
