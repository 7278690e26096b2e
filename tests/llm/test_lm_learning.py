"""LM scoring learns from every text and word that is not held out, in shards whose split makes no difference."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm import lm_mixing


def test_shards_are_cut_alike_wherever_batches_end():
    rnd, shards = random.Random(3), [2] * 7 + [4] * 16 + [5] + [9] * 40
    want = None
    for _ in range(5):
        cuts = sorted({0, len(shards), *(rnd.randrange(len(shards)) for _ in range(6))})
        batches = [pa.RecordBatch.from_pydict({"shard": shards[a:b], "x": list(range(a, b))}) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [(s, t.column("x").to_pylist()) for s, t in lm_mixing.dealt(iter(batches), 16)]
        want = want or got
        assert got == want and sum((x for _, x in got), []) == list(range(len(shards)))
    assert [(s, len(x)) for s, x in want] == [(2, 7), (4, 16), (5, 1), (9, 16), (9, 16), (9, 8)]


def test_averages_go_by_mass():
    parts = [(np.array([1.0, 5.0, 9.0]), np.array([1.0, 0.0, 0.0])), (np.array([4.0, 7.0, 9.0]), np.array([2.0, 3.0, 0.0]))]
    assert lm_mixing.averaged(parts, np.array([0.0, 0.0, 0.5])).tolist() == [3.0, 7.0, 0.5]


def test_repeats_are_learned_from_all_texts(spark, docs_of):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(5, 60))) for _ in range(90)]
    rows = docs_of([*texts, *[texts[0]] * 30, None]).withColumn("held_out", F.col("doc_id") % 5 == 1).withColumn("text", F.col("text").cast("binary"))
    used = [t for i, t in enumerate([*texts, *[texts[0]] * 30]) if i % 5 != 1]
    asked = hits = 0
    for t in used:
        for _, contexts, hit in lm_mixing.Followers(lm_mixing.Indexed([lm_mixing.tokens(t.encode())])).questions():
            asked, hits = asked + len(hit), hits + int(hit.sum())
    found = [lm_mixing.learn_repeats(rows.repartition(n), 10) for n in (1, 6)]
    for table, new in zip(found[0].tables, lm_mixing.Repeats().tables, strict=True):
        assert abs((table - new)[1].sum() - hits) < 1e-6 and abs((table - new).sum() - asked) < 1e-6
    assert (found[0].weights == found[1].weights).all() and all((a == b).all() for a, b in zip(found[0].tables, found[1].tables, strict=True))


def test_classes_are_learned_from_all_texts(spark):
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("uno "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("one "), F.col("id").cast("string")))
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), own.cast("binary").alias("text"), F.when(F.col("id") % 3 == 0, "es").otherwise("en").alias("lang"), (F.col("id") % 7 == 2).alias("held_out"))
    counts = np.full((lm_mixing.BUCKETS, 2), 0.5)
    for i in range(6000):
        if i % 7 != 2:
            np.add.at(counts, (lm_mixing.buckets([b"one" if i % 3 else b"uno", str(i).encode(), b""]), int(i % 3 == 0)), 1)
    got = lm_mixing.learn_classes(rows)
    assert np.allclose(got.logs, np.log(counts / counts.sum(axis=0)))
    assert got.of(lm_mixing.Indexed([[b"one", b""], [b"uno", b""]])) == [0, 1]


def test_costs_do_not_depend_on_the_split(spark):
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choice(b"abcdef") for _ in range(rnd.randrange(1, 9))) for _ in range(700)})
    rows = spark.createDataFrame([(bytearray(w), 3, z, rnd.randrange(4)) for w in words for z in (0, 1)], "token binary, c bigint, z int, own bigint")
    one, two = ({(bytes(r["token"]), r["z"]): r["cost"] for r in lm_mixing.token_costs(rows.repartition(n), 2 * len(words), 100).collect()} for n in (1, 5))
    assert one == two and len(one) == 2 * len(words) and all(c < 0 for c in one.values())


def test_words_are_numbered_as_tokens_gives_them():
    rnd = random.Random(1)
    for kind in (b" ab\t\n\x0b\x0c\r\x00\x1cAZ[\xff\xc3\xa9\x85\xa0", bytes(range(256)), b"  aB", b"q"):
        for _ in range(40):
            texts = [None if rnd.random() < 0.1 else bytes(rnd.choice(kind) for _ in range(rnd.choice([0, 1, 3, 20, 300]))) for _ in range(rnd.randrange(8))]
            got = lm_mixing.Indexed.of(pa.array([b"x y", *texts, b"z"], pa.binary()).slice(1, len(texts)))
            want = [lm_mixing.tokens(t) for t in texts]
            assert [got.distinct[i] for i in got.ids] == sum(want, []) and got.lens.tolist() == [len(w) for w in want]
            assert got.distinct == list(dict.fromkeys(sum(want, []))) and got.sizes.tolist() == [len(w) for w in got.distinct]
            assert (got.crc & (lm_mixing.BUCKETS - 1)).tolist() == lm_mixing.buckets(got.distinct).tolist()


def test_bytes_after_the_same_bytes_are_worked_out_once(monkeypatch):
    rnd, rng = random.Random(6), np.random.default_rng(6)
    words = sorted({bytes(rnd.choice(b"abc\x01!") for _ in range(rnd.randrange(9))) for _ in range(500)} | {b"c" * 90, b"c" * 91}, key=lambda w: w + b" ")
    own, model = rng.integers(1, 9, len(words)).astype(float), lm_mixing.Model.new()
    model.zeros[:], model.ones[:] = rng.integers(0, 50, lm_mixing.SLOTS), rng.integers(0, 50, lm_mixing.SLOTS)
    text = lm_mixing.Spelled(words, np.zeros(len(words), np.int64))
    prefixes = lm_mixing.Prefixes(text, words, own, np.zeros(len(words), np.int64), [np.zeros((2, 0), np.float32)])
    bits, mix = [], lm_mixing.Mixer.mix
    monkeypatch.setattr(lm_mixing.Mixer, "mix", lambda self, inputs, gate: bits.append(len(gate)) or mix(self, inputs, gate))
    cost = model.prepare().costs(text, prefixes)
    known = {(w + b" ")[: i + 1] for w in words for i in range(min(len(w) + 1, lm_mixing.DEPTH))}
    beyond = sum(max(0, len(w) + 1 - lm_mixing.DEPTH) for w in words)
    assert sum(bits) == 8 * (len(known) + beyond) < 8 * len(text.data)
    model.learn(text, prefixes, own, 0.15)
    once = model.mixer
    model.mixer, prefixes.source = lm_mixing.Mixer.new(), np.arange(len(text.data))
    assert (model.costs(text, prefixes) == cost).all()
    model.learn(text, prefixes, own, 0.15)
    assert np.allclose(once.weights, model.mixer.weights, rtol=0, atol=1e-9) and np.allclose(once.refine, model.mixer.refine, rtol=0, atol=1e-9)


def test_counts_do_not_depend_on_how_often_they_are_handed_on(spark, docs_of):
    rows = docs_of(["a b a", "b C", "c c d", None, "", "a\tE"] * 3).select(F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 4 == 1).alias("held_out"))
    logs = np.zeros((lm_mixing.BUCKETS, 2))
    logs[lm_mixing.buckets([b"c"]), 1] = 1
    classes, want, all_of = lm_mixing.Classes(logs, np.zeros(2)), {}, {}
    for r in rows.collect():
        words = lm_mixing.tokens(r["text"])
        for w in words:
            key = (w, int(b"c" in words))
            want[key] = want.get(key, 0) + (not r["held_out"])
            all_of[w] = all_of.get(w, 0) + (not r["held_out"])
    for most in (0, 1, 200_000):
        got = {(bytes(r["token"]), r["z"]): (r["own"], r["c"]) for r in lm_mixing.count_tokens(rows, classes, most).collect()}
        assert got == {(w, z): (n, all_of[w]) for (w, z), n in want.items()}
