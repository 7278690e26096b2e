"""Shared pieces: inputs, written cuts of lineage, word expressions, learning folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body and as the characters themselves.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh local one only where none is named and the driver is the only executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = own.get() if own.isDefined() else f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet (in ``files`` files at most) into the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{shared_dir(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by cut() that no later plan reads."""
    path = getattr(df, "_quillstone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
        df._quillstone_path = None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column, separators: str = SPACE, trim: str = SPACE_CHARS) -> Column:
    """The maximal runs of characters outside the class body ``separators``; null and blank texts give an empty array."""
    held = F.btrim(F.coalesce(text, F.lit("")), F.lit(trim))
    return F.when(held == "", F.array().cast("array<string>")).otherwise(F.split(held, f"[{separators}]+"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns of a documents table; whatever else it has is left behind."""
    return df.select("doc_id", "text", *more)
