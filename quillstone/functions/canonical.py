"""Canonical JSON and NFC text: the two scalar functions without a JVM equivalent, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes; null for what is not JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        except ValueError:
            return None

    return text.map(one)


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def content_hash(text: Column) -> Column:
    return F.sha2(nfc(text), 256)


def record_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)
