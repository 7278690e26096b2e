"""Quality classifier: regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, fold, load
from quillstone.llm.doc_stats import RATIOS, add_stats, ratio

#: Statistics that are squeezed by log1p; the others are shares, squeezed by a square root.
LOGGED = {"mean_word_chars", "words_per_line", "words"}


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor of the shrunk covariance, and log of prior over its determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row, from the difference of the two Mahalanobis log densities."""
        dens = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = factor @ (x - mean).T
            dens.append(offset - 0.5 * np.einsum("ij,ij->j", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def transformed(stats: DataFrame, *kept: str) -> DataFrame:
    names = list(RATIOS)
    return stats.select(*kept, *[(F.log1p(ratio(n)) if n in LOGGED else F.sqrt(ratio(n))).alias(n) for n in names])


def learn(rows: DataFrame, shrinkage: float = 0.2, ridge: float = 1e-3) -> Discriminant | None:
    """rows(_y, statistics): counts, sums and products per class in one aggregate of fixed width.

    Covariances are shrunk towards the pooled one by ``shrinkage`` and get ``ridge``
    on the diagonal. Without rows of both labels there is no model (None).
    """
    names = list(RATIOS)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r["_y"]: r for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if set(got) != {0, 1}:
        return None
    total, covs, means, counts = sum(r["n"] for r in got.values()), [], [], []
    for y in (0, 1):
        n, mean = got[y]["n"], np.array([got[y][f"s{i}"] for i in range(len(names))]) / got[y]["n"]
        second = np.zeros((len(names), len(names)))
        for i, j in pairs:
            second[i, j] = second[j, i] = got[y][f"p{i}_{j}"] / n
        covs.append(second - np.outer(mean, mean))
        means.append(mean)
        counts.append(n)
    pooled = sum(c * n for c, n in zip(covs, counts, strict=True)) / total
    factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled + ridge * np.eye(len(names))) for c in covs]
    whitening = [np.linalg.inv(f) for f in factors]
    offsets = [np.log(n / total) - np.log(np.diag(f)).sum() for n, f in zip(counts, factors, strict=True)]
    return Discriminant(np.array(means), np.array(whitening), np.array(offsets))


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """stats(doc_id, held_out, counts) -> doc_id, held_out, score, predicted; without a model every score is 0.5."""
    names, kept = list(RATIOS), stats.select("doc_id", "held_out").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.zeros((0, len(names)))
            p = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return transformed(stats, "doc_id", "held_out").mapInArrow(run, f"{out}, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn only from labelled rows outside the held-out third.

    Null and empty texts are scored from statistics of 0; repeated rows are scored
    alike; an empty table gives an empty result; a label seen with both values for
    one id is not learned from.
    """
    docs = documents(load(spark, sf_dir, "documents")).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    stats = cut(add_stats(docs), "qda-stats")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z")
    model = learn(transformed(stats.where(~F.col("held_out")).join(labels, "doc_id"), "_y"))
    return score(stats, model)
