"""JSON-lines transcripts as rows: normalized events and located errors in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.canonical import canonical_json

#: Names that a field may have, the first non-null one holds.
ALIASES = {
    "source_id": ("id", "uuid", "event_id", "message_id"),
    "declared": ("type", "event_type"),
    "role": ("role", "author", "sender"),
    "text": ("content", "text", "body"),
    "time": ("timestamp", "created_at", "time"),
    "tool_name": ("tool_name", "tool"),
    "tool_call_id": ("tool_call_id", "tool_use_id", "call_id"),
    "parent_id": ("parent_id", "parent_uuid", "parent"),
}
#: Event types, and the type of each role.
TYPES = ("user_message", "assistant_message", "system_message", "developer_message", "tool_call", "tool_result", "other")
ROLES = {"user": "user_message", "assistant": "assistant_message", "system": "system_message", "developer": "developer_message", "tool": "tool_result"}


def first_of(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the record's fields that is there and not null, as a variant."""
    each = [F.try_variant_get(record, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in each])


def alias(record: Column, names: tuple[str, ...]) -> Column:
    return first_of(record, names).try_cast("string")


def identifier(value: Column) -> Column:
    """A variant as an id: text as it is, an empty one too, whole numbers as digits; anything else is none."""
    whole = F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return F.when((F.schema_of_variant(value) == "STRING") | whole, value.try_cast("string"))


def parse_time(value: Column) -> Column:
    """A variant as a time: a number of epoch seconds or ISO text with a zone; anything else, a time without a zone too, is null."""
    kind, text = F.schema_of_variant(value), value.try_cast("string")
    zoned = F.when((kind == "STRING") & text.rlike(r"(?i)\d(z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
    number = F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), value.try_cast("double"))
    return F.coalesce(zoned, F.timestamp_seconds(number))


def classify(declared: Column, role: Column) -> Column:
    """The declared type if it is one, else what the declared type or the role maps to, else other."""
    mapped = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(declared.isin(*TYPES), declared).otherwise(F.coalesce(F.try_element_at(mapped, F.coalesce(F.lower(declared), F.lit(""))), F.try_element_at(mapped, F.coalesce(F.lower(role), F.lit(""))), F.lit("other")))


def normalize(lines: DataFrame) -> DataFrame:
    """lines(position, line) -> position, reason (null for events) and the event's fields.

    Blank lines, invalid JSON and values that are not objects become rows with a
    reason and the line's first 200 characters, in the same plan as the events.
    """
    record = F.try_parse_json("line")
    kind = F.schema_of_variant(record)
    reason = F.when(F.trim("line") == "", "blank").when(record.isNull(), "invalid_json").when(~F.startswith(kind, F.lit("OBJECT")), "not_object")
    held = lines.select("position", "line", record.alias("r"), reason.alias("reason"))
    good = F.col("reason").isNull()
    ids = ("source_id", "tool_call_id", "parent_id")
    parsed = [F.when(good, (identifier(first_of(F.col("r"), names)) if n in ids else alias(F.col("r"), names))).alias(n) for n, names in ALIASES.items()]
    fields = held.select("position", "reason", F.when(~good, F.substring("line", 1, 200)).alias("detail"), *parsed, F.when(good, parse_time(first_of(F.col("r"), ALIASES["time"]))).alias("timestamp"), F.when(good, F.col("line")).alias("raw"))
    return fields.select(
        "position", "reason", "detail", "source_id", F.when(F.col("reason").isNull(), classify(F.col("declared"), F.col("role"))).alias("type"), F.coalesce("declared", "role").alias("source_type"), "text", F.col("time").alias("time_text"), "timestamp", "tool_name", "tool_call_id", "parent_id", "raw"
    )


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """position, line of a file: the file's block order is kept by a monotonic id, no single-task window."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.col("value").alias("line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events and located errors of a JSON-lines file."""
    return normalize(lines_of(spark, path))


#: Fields of an agent's record that go along with its events.
METADATA = ("cwd", "gitBranch", "version", "isSidechain", "isCompactSummary")


def block_text(block: Column) -> Column:
    """A block's content, else text, else input: text as it is, a list's text items by lines, an object as JSON with sorted keys."""
    value = first_of(block, ("content", "text", "input"))
    kind = F.schema_of_variant(value)
    items = F.filter(F.transform(value.try_cast("array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")))), lambda t: t.isNotNull())
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(items, "\n")).when(F.startswith(kind, F.lit("OBJECT")), canonical_json(F.to_json(value))).otherwise(value.try_cast("string"))


def agent_events(records: DataFrame, thinking: bool = False) -> DataFrame:
    """records(position, line) of an agent transcript -> position, block, type, text and the event's fields; located errors as in normalize.

    User and assistant records that are not meta give an event for their text, or one
    for each block of text, tool use or tool result (and of thinking, if asked for). Blank
    text gives none. A record of nothing but thinking gives one event without text that
    counts its blocks. metadata holds the record's METADATA fields that are there.
    """
    record = F.try_parse_json("line")
    reason = F.when(F.trim("line") == "", "blank").when(record.isNull(), "invalid_json").when(~F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), "not_object")
    held = records.select("position", "line", record.alias("r"), reason.alias("reason"))
    get = lambda p, k="string": F.try_variant_get("r", p, k)
    none = lambda k="string": F.lit(None).cast(k)
    errors = held.where("reason is not null").select("position", F.lit(0).alias("block"), "reason", F.substring("line", 1, 200).alias("detail"), *[none().alias(c) for c in ("source_id", "parent_id", "type", "source_type", "text", "tool_name", "tool_call_id")], none("timestamp").alias("timestamp"), none("map<string,string>").alias("metadata"), none("int").alias("thinking"))
    pairs = [F.when(get(f"$.{n}").isNotNull(), F.struct(F.lit(n).alias("key"), get(f"$.{n}").alias("value"))) for n in METADATA]
    said = held.where((F.col("reason").isNull()) & get("$.type").isin("user", "assistant") & ~F.coalesce(get("$.isMeta", "boolean"), F.lit(False)))
    content = get("$.message.content", "variant")
    base = said.select(
        "position",
        get("$.type").alias("role"),
        identifier(get("$.uuid", "variant")).alias("source_id"),
        identifier(get("$.parentUuid", "variant")).alias("parent_id"),
        parse_time(get("$.timestamp", "variant")).alias("timestamp"),
        F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("metadata"),
        F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), content.try_cast("array<variant>")).otherwise(F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), content.try_cast("string").alias("text")))))).alias("blocks"),
    )
    typed = lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit(""))
    all_thinking = (F.size("blocks") > 0) & F.forall("blocks", lambda b: typed(b) == "thinking")
    each = base.select(*[c for c in base.columns if c != "blocks"], F.when(all_thinking, F.size("blocks")).alias("thinking"), F.posexplode("blocks").alias("block", "b"))
    kind = typed(F.col("b"))
    message = F.concat("role", F.lit("_message"))
    type_ = F.when(kind == "text", message).when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").when(kind == "thinking", message)
    whole = F.when(kind == "thinking", F.try_variant_get("b", "$.thinking", "string")).otherwise(block_text(F.col("b")))
    alone = F.col("thinking").isNotNull() & (F.col("block") == 0) & F.lit(not thinking)
    events = each.select(
        "position", "block", none().alias("reason"), none().alias("detail"), "source_id", "parent_id", type_.alias("type"), F.col("role").alias("source_type"), F.when(alone, F.lit("")).otherwise(whole).alias("text"),
        F.try_variant_get("b", "$.name", "string").alias("tool_name"), F.coalesce(F.try_variant_get("b", "$.tool_use_id", "string"), F.when(kind == "tool_use", F.try_variant_get("b", "$.id", "string"))).alias("tool_call_id"), "timestamp", "metadata", "thinking", kind.alias("kind"), alone.alias("alone"),
    )
    kept = events.where("type is not null").where(F.col("alone") | ((F.trim(F.coalesce("text", F.lit(""))) != "") & ((F.col("kind") != "thinking") | F.lit(thinking))))
    return kept.drop("kind", "alone").unionByName(errors)


def transcript_blocks(records: DataFrame) -> DataFrame:
    """records(position, line) of an agent transcript -> one row for each text, tool use or tool result block of user and assistant records that are not meta."""
    r = records.select("position", F.try_parse_json("line").alias("r"))
    get = lambda p, k="string": F.try_variant_get("r", p, k)
    base = r.select("position", get("$.type").alias("role"), get("$.uuid").alias("source_id"), get("$.parentUuid").alias("parent_id"), get("$.isMeta", "boolean").alias("meta"), get("$.message.content", "array<variant>").alias("blocks"), get("$.message.content").alias("whole"))
    kept = base.where(F.col("role").isin("user", "assistant") & ~F.coalesce("meta", F.lit(False)))
    plain = kept.where("blocks is null").select("position", F.lit(0).alias("block"), "source_id", "parent_id", F.concat("role", F.lit("_message")).alias("type"), F.col("whole").alias("text"), F.lit(None).cast("string").alias("tool_call_id"))
    each = kept.select("position", "role", "source_id", "parent_id", F.posexplode("blocks").alias("block", "b"))
    of = lambda p: F.try_variant_get("b", p, "string")
    kind = of("$.type")
    typed = F.when(kind == "text", F.concat("role", F.lit("_message"))).when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result")
    blocks = each.select("position", "block", "source_id", "parent_id", typed.alias("type"), F.coalesce(of("$.text"), of("$.content"), of("$.input")).alias("text"), F.coalesce(of("$.id"), of("$.tool_use_id")).alias("tool_call_id"))
    return plain.unionByName(blocks.where("type is not null")).where("trim(coalesce(text, '')) <> ''")
