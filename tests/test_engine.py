"""Operators without SQL, and edge cases."""

import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillstone.functions import canonical
from quillstone.functions import text as T
from quillstone.operators import extraction as X
from quillstone.operators import log as L
from quillstone.operators import state as S
from quillstone.operators import thread as H
from quillstone.operators.retrieval import search
from quillstone.plans import compile as K
from quillstone.plans import package as P
from quillstone.plans.compaction import compaction_plan
from quillstone.sources import jsonl
from quillstone.sources.tables import archive, state_items
from quillstone.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def test_canonical_json_and_nfc(spark):
    texts = ['{"b": 1, "a": "é😀", "c": null}', "[1.5, true]", "nope", None, '"x"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.canonical_json("t")).collect()]
    dump = lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
    assert got == [dump(texts[0]), dump(texts[1]), None, None, '"x"']
    row = spark.createDataFrame([("é",)], "t string").select(canonical.content_hash(F.col("t"))).first()
    assert row[0] == hashlib.sha256(unicodedata.normalize("NFC", "é").encode()).hexdigest()


def test_jsonl_errors_are_rows(spark, tmp_path):
    lines = ['{"id": "a", "role": "user", "content": "hi", "timestamp": "2024-01-01T00:00:00Z"}', "", "{bad", "[1]", '{"uuid": 7, "type": "tool_call", "text": "x", "time": "2024-01-01T00:00:00"}', '{"author": "robot", "created_at": 5}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = {r["position"]: r for r in jsonl.read(spark, str(tmp_path / "t.jsonl")).collect()}
    order = [got[k] for k in sorted(got)]
    assert [r["reason"] for r in order] == [None, "blank", "invalid_json", "not_object", None, None]
    assert [r["type"] for r in order] == ["user_message", None, None, None, "tool_call", "other"]
    assert order[4]["source_id"] == "7" and order[4]["timestamp"] is None and order[0]["timestamp"] is not None and order[5]["timestamp"].second == 5


def test_transcript_blocks(spark):
    lines = [
        {"type": "user", "uuid": "1", "message": {"content": "ask"}},
        {"type": "assistant", "uuid": "2", "parentUuid": "1", "message": {"content": [{"type": "text", "text": "say"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c", "input": "ls"}]}},
        {"type": "user", "uuid": "3", "isMeta": True, "message": {"content": "meta"}},
        {"type": "summary", "uuid": "4"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "position int, line string")
    got = sorted((r["position"], r["block"], r["type"], r["text"]) for r in jsonl.transcript_blocks(df).collect())
    assert got == [(0, 0, "user_message", "ask"), (1, 0, "assistant_message", "say"), (1, 2, "tool_call", "ls")]


def test_search_edges(spark):
    log = spark.createDataFrame([("s", 0, "a", "k", "port 8082"), ("s", 1, "b", "k", "port"), ("s", 2, "c", "k", "")], "session_id string, seq int, id string, kind string, payload string")
    assert search(log, "the of is", 5).count() == 0
    assert [r["id"] for r in search(log, "which port 8082", 5).collect()] == ["a", "b"]


def test_chains_forks_and_cycles(spark):
    rows = [("1", None, 1), ("2", "1", 2), ("3", "2", 3), ("4", "1", 4), ("x", "y", 1), ("y", "x", 1)]
    items = spark.createDataFrame(rows, "id string, supersedes string, created_at int")
    got = {r["id"]: (r["newest"], r["steps"]) for r in S.newest(items, max_rounds=4).collect()}
    assert got["1"] == ("3", 2) and got["4"] == ("4", 0) and got["x"][1] is None


def test_live_branch(spark):
    rows = [("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, "c", "a"), ("s", 3, "d", "c"), ("s", 4, None, None), ("s", 5, "e", "lost")]
    t = spark.createDataFrame(rows, "session_id string, seq int, id string, parent_id string")
    assert sorted(r["seq"] for r in H.live(t).collect()) == [0, 2, 3, 4, 5]
    assert [r["id"] for r in H.abandoned(t).collect()] == ["b"]


def test_compile_fits_budget(spark):
    items, log, budget = state_items(spark, SF), archive(spark, SF), 120
    got = K.compile_context(items, log, "go on with the work", budget)
    used = {}
    for r in got.collect():
        used.setdefault(r["session_id"], {"state": 0, "recent": 0})[r["section"]] += r["cost"]
    assert used and all(u["state"] <= 72 and u["state"] + u["recent"] <= budget - 5 for u in used.values())


def test_empty_tables(spark):
    log = archive(spark, SF).limit(0)
    for df in (L.tail(log, 2), L.verify(log), L.recent_window(log, 9), L.greedy_windows(log, F.length("payload"), 9), L.session_sizes(log), search(log, "la", 3)):
        assert df.count() == 0
    assert spark.range(1).select(T.word_count(F.lit(None).cast("string"))).first()[0] == 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "a", "role": "user", "content": "hi"}\nnope\n')
    run = lambda: I.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), jsonl.normalize).awaitTermination()
    run()
    (tmp_path / "in" / "b.jsonl").write_text('{"id": "b", "role": "assistant", "content": "yo"}\n')
    run()
    run()
    key = lambda df: sorted((r["reason"] or "", r["source_id"] or "") for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(jsonl.read(spark, str(tmp_path / "in")))


def test_verdicts(spark):
    texts = ["YES", "\n **no.** because", "maybe", "", None, "yes, sure"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.verdict(F.col("t"))).collect()]
    assert got == ["YES", None, None, None, None, None]
    assert spark.createDataFrame([("\n **no.**\nbecause",)], "t string").select(X.verdict(F.col("t"))).first()[0] == "NO"


def test_renderers(spark):
    rows = spark.createDataFrame([("p", 1, "state", "é s"), ("p", 9, "task", "do"), ("p", 2, "recent", "r")], "package_id string, rank int, section string, text string")
    body = {t: json.loads(P.render(rows, t).first()["body"]) for t in ("openai", "anthropic", "gemini", "else")}
    assert body["openai"]["messages"] == [{"role": "system", "content": "é s\n\nr"}, {"role": "user", "content": "do"}]
    assert body["anthropic"] == {"system": "é s\n\nr", "messages": [{"role": "user", "content": "do"}]}
    assert body["gemini"]["contents"] == [{"parts": [{"text": "do"}]}] and body["else"] == {"context": "é s\n\nr", "task": "do"}


def test_allocate():
    import pytest

    assert P.allocate(160) == (64, 96)
    with pytest.raises(ValueError):
        P.allocate(49)


def test_empty_state_and_results(spark):
    items = state_items(spark, SF).where("false")
    for df in (S.current(items), S.newest(items), S.duplicate_active(items), S.supersession_forks(items), S.dangling(items), K.state_section(items, 9), X.literals(archive(spark, SF).where("false"))):
        assert df.count() == 0


def test_compaction_plan(spark):
    log = spark.createDataFrame([("a", 0, "x " * 10), ("b", 0, "x " * 100), ("b", 1, "x " * 30), ("b", 2, None), ("c", 0, "x " * 20), ("c", 1, "x " * 300)], "session_id string, seq int, payload string")
    got = {r["session_id"]: tuple(r)[1:] for r in compaction_plan(log, 100).collect()}
    assert got == {"a": (13, True, 0, 13, 0), "b": (139, False, 1, 36, 60), "c": (326, False, 2, 0, 60)}
    assert compaction_plan(log.where("false"), 100).count() == 0
    with pytest.raises(ValueError):
        compaction_plan(log, 10)
