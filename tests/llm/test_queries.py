"""All queries on empty tables and with clashing columns; held-out figures and brute-force scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language_id, quality_qda, quality_rules, registry, simhash
from quillstone.llm.base import documents, fold
from quillstone.llm.doc_stats import RATIOS, add_stats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    full = registry.QUERIES[name](spark, empty_dir)
    assert full.count() == 0 and len(full.columns) > 1


def test_rules_hold_on_rows_that_they_did_not_see(spark):
    docs, labels = documents(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")
    stats = add_stats(docs).cache()
    seen = fold(F.col("doc_id"), 4) != 1
    rules = quality_rules.learn(stats, labels.where(seen))
    got = quality_rules.apply_rules(stats, rules).join(labels.where(~seen), "doc_id").select("kept", "quality", "base_failed").collect()
    judged = [r for r in got if not r["base_failed"]]
    assert len(judged) > 30 and sum(r["kept"] == (r["quality"] == 1) for r in judged) / len(judged) > 0.8
    stats.unpersist()


def test_qda_scores_equal_densities(spark):
    docs = documents(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_qda.op5_quality_classifier(spark, SF).collect()}
    rows = quality_qda.transformed(add_stats(docs), "doc_id", "held_out").collect()
    x = {r["doc_id"]: np.array([r[n] for n in RATIOS]) for r in rows}
    own = {y: np.array([x[r["doc_id"]] for r in rows if not r["held_out"] and labels.get(r["doc_id"]) == y]) for y in (0, 1)}
    total = sum(map(len, own.values()))
    covs = {y: np.cov(v.T, bias=True) for y, v in own.items()}
    pooled = sum(covs[y] * len(own[y]) for y in own) / total
    dens = {}
    for y, v in own.items():
        c = 0.8 * covs[y] + 0.2 * pooled + 1e-3 * np.eye(len(pooled))
        inverse, log_det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        dens[y] = {i: np.log(len(v) / total) - 0.5 * log_det - 0.5 * (p - v.mean(axis=0)) @ inverse @ (p - v.mean(axis=0)) for i, p in x.items()}
    for i, r in got.items():
        want = 1 / (1 + np.exp(np.clip(dens[0][i] - dens[1][i], -700, 700)))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5)


def test_language_scores_equal_plain_counts(spark, docs_of):
    texts = [("the cat is on the mat", "en"), ("la casa de la", "es"), ("der hund und die", "de"), ("the dog", "en"), ("el perro en la casa", "es")]
    model = language_id.learn(docs_of(texts).select("text", "lang"))
    got = language_id.predict(documents(docs_of(["the casa", "und 7"])), model).orderBy("doc_id").collect()

    def grams(text):
        points = f" {text} "
        hashed, _ = language_id.buckets([np.array([ord(c) for c in points], np.uint32)], [False], (2, 3), 15)
        return [b for b in hashed.ravel().tolist() if b < 1 << 15]

    langs = ["de", "en", "es"]
    counts = {lang: np.full(1 << 15, 0.5) for lang in langs}
    for t, lang in texts:
        np.add.at(counts[lang], grams(t), 1)
    for r, text in zip(got, ["the casa", "und 7"], strict=True):
        logs = np.array([np.log(sum(x == lang for _, x in texts) / 5) + sum(np.log(counts[lang][b] / counts[lang].sum()) for b in grams(text)) for lang in langs])
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r["lang_pred"] == langs[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_older_columns_of_added_names_give_way(spark, docs_of):
    rows = docs_of(["a b c", "a b c"]).withColumns({"fp": F.lit("x"), "component_id": F.lit("y"), "lang_pred": F.lit("z")})
    assert [r["component_id"] for r in simhash.near_duplicates(rows).collect()] == [0, 0]
    model = language_id.learn(rows.select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(rows, model).collect()} == {"en"}
