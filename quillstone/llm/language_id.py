"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import documents, fold, load

#: Fixed odd multipliers of the hash of an n-gram, one for each place.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
#: Letters, and numbers other than decimal digits (as in x²), which has_letter() tells apart.
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 18


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text or ""))


def pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[list[int], list[np.ndarray], list[bool]]]:
    """Texts as code points with a space before and after, in groups of about PIECE; long texts go in overlapping pieces. Whether a piece goes on."""
    rows, parts, goes_on, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
        for at in range(0, len(points) - overlap, PIECE):
            rows.append(i)
            parts.append(points[at : at + PIECE + overlap])
            goes_on.append(at + PIECE < len(points) - overlap)
            size += len(parts[-1])
            if size >= PIECE:
                yield rows, parts, goes_on
                rows, parts, goes_on, size = [], [], [], 0
    if rows:
        yield rows, parts, goes_on


def buckets(parts: list[np.ndarray], goes_on: list[bool], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the parts, one row for each order; 1 << bits where an n-gram would run into the next part. Starts of the parts.

    Pieces of one text overlap by the longest order less one; n-grams that begin in the
    overlap belong to the next piece.
    """
    points, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    out = np.full((len(orders), len(points)), 1 << bits, np.int32)
    for k, n in enumerate(orders):
        mixed = np.full(len(points) - n + 1, n * 0x9E37 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            mixed ^= points[j : len(points) - n + 1 + j] * FACTORS[j]
            mixed = (mixed << np.uint32(13)) | (mixed >> np.uint32(19))
        mixed *= FACTORS[0]
        out[k, : len(mixed)] = mixed >> np.uint32(32 - bits)
        for j in range(1, n):
            out[k, ends - j] = 1 << bits
        for i in np.flatnonzero(goes_on).tolist():
            out[k, ends[i] - len(parts[i]) + PIECE : ends[i]] = 1 << bits
    return out, np.concatenate(([0], ends[:-1]))


@dataclass
class LanguageModel:
    langs: list[str]
    logs: np.ndarray  # (buckets + 1, languages); the last row is 0
    priors: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def log_densities(self, texts: list[str | None]) -> np.ndarray:
        out = np.tile(self.priors, (len(texts), 1))
        for rows, parts, goes_on in pieces(texts, max(self.orders) - 1):
            hashed, starts = buckets(parts, goes_on, self.orders, self.bits)
            total = self.logs[hashed[0]]
            for h in hashed[1:]:
                total = total + self.logs[h]
            np.add.at(out, rows, np.add.reduceat(total, starts, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; und and 0 where there is no letter or nothing was learned."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        dens = self.log_densities(texts)
        best = dens.argmax(axis=1)
        score = 1 / np.exp(dens - dens.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([has_letter(t) for t in texts], dtype=bool)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def learn(rows: DataFrame, orders: tuple[int, ...] = (2, 3), bits: int = 15, alpha: float = 0.5) -> LanguageModel:
    """rows(text, lang): n-gram counts of every row with a language; a task sends at most languages x buckets of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256).to_pylist()
                for lang in langs[at : at + 256]:
                    counts.setdefault(lang, np.zeros((1 << bits) + 2, np.int64))[-1] += 1
                for lang in set(langs[at : at + 256]):
                    for _, parts, goes_on in pieces([t for t, x in zip(texts, langs[at:], strict=False) if x == lang], max(orders) - 1):
                        hashed, _ = buckets(parts, goes_on, orders, bits)
                        counts[lang][:-1] += np.bincount(hashed.ravel(), minlength=(1 << bits) + 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    sums = rows.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    table = np.zeros(((1 << bits) + 2, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    table[sums.column("bucket").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    grams, docs = table[: 1 << bits] + alpha, table[-1]
    logs = np.vstack([np.log(grams / grams.sum(axis=0)), np.zeros(len(langs))]).astype(np.float32)
    return LanguageModel(langs, logs, np.log(docs / docs.sum()) if langs else np.zeros(0), orders, bits)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score in place of older columns of these names; the model's matrix is broadcast, its size is languages x buckets."""
    docs = docs.drop("lang_pred", "score")
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                langs, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{out}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document.

    Learned from the rows outside the held-out quarter that have a language. Null
    texts and texts without a letter are und with score 0; ties go to the first
    language in order of name. Repeated rows stay; an empty table, or one without
    languages to learn, predicts und.
    """
    docs = documents(load(spark, sf_dir, "documents"), "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
