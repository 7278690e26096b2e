"""Statistics of whole texts as Spark expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.base import SPACE, let, words_of

#: name -> (numerator, denominator) of the ratio features; counts are of the columns of add_stats().
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "mean_word_chars": ("word_chars", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "unique_ratio": ("n_unique", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def repeated_words(words: Column, n: Column, window: int = 3) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more in the array.

    Each window becomes one long: the high bits of its hash, the low bits its position,
    so one sort of longs brings equal windows together in order of position; neighbours
    with equal high bits are compared word by word. O(n log n) in a row, nothing explodes.
    """
    bits = F.ceil(F.log2(n + 1)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - F.lit(1).cast("bigint")

    def of_packed(packed: Column, mask: Column, w: Column) -> Column:
        def same(i: Column) -> Column:
            a, b = F.get(packed, i), F.get(packed, i + 1)
            p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal = F.lit(True)
            for k in range(window):
                equal = equal & (F.get(w, p + k) == F.get(w, q + k))
            return F.when(F.call_function("shiftright", a.bitwiseXOR(b), bits_of(mask)) == 0, equal).otherwise(F.lit(False))

        pairs = F.filter(F.sequence(F.lit(0), F.size(packed) - 2), same)
        place = lambda i: F.get(packed, i).bitwiseAND(mask)
        places = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(place(i), place(i + 1))))))
        start = F.struct(F.lit(-window).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(window).cast("bigint"), p - acc["last"])).alias("sum"))
        return F.when(F.size(packed) < 2, F.lit(0).cast("bigint")).otherwise(F.aggregate(places, start, step, lambda acc: acc["sum"]))

    def bits_of(mask: Column) -> Column:
        return F.bit_count(mask)

    def keys(w: Column, mask: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(w, i.cast("int") + k) for k in range(window)])
        return F.sort_array(F.transform(F.sequence(F.lit(0).cast("bigint"), F.size(w).cast("bigint") - window), lambda i: hashed(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i)))

    return F.when(n < window, F.lit(0).cast("bigint")).otherwise(let(words, lambda w: let(low, lambda mask: let(keys(w, mask), lambda packed: of_packed(packed, mask, w)))))


def add_stats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with counts of its whole texts and without the text.

    A null text counts as an empty one; all counts of it are 0. Repeated rows stay
    repeated. One pass, no shuffle, JVM expressions only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c != "text"]
    arrays = docs.select(*kept, text.alias("_t"), words_of(text).alias("_w"), F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))).alias("_l"))
    n = F.size("_w")
    count = lambda pattern: F.char_length(F.regexp_replace("_t", pattern, "")).cast("bigint")
    return arrays.select(
        *kept,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_w"), n).alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        count(r"[^A-Z]+").alias("n_upper"),
        count(r"[^!?.,;:]+").alias("n_marks"),
        count(r"[^0-9]+").alias("n_digits"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("n_unique"),
    )


def ratio(name: str) -> Column:
    above, below = RATIOS[name]
    value = F.col(above).cast("double")
    return value if below is None else F.when(F.col(below) > 0, value / F.col(below)).otherwise(F.lit(0.0))
