"""Writing, importing, discovery, extraction, compaction, incremental runs and plug-ins on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone import plugins
from quillstone.functions import parse, render
from quillstone.functions import text as T
from quillstone.operators import evaluation as E
from quillstone.operators import extraction as X
from quillstone.operators import integrity as G
from quillstone.operators import log as L
from quillstone.operators import state as S
from quillstone.operators import thread as H
from quillstone.operators.retrieval import search
from quillstone.plans import compaction as C
from quillstone.plans import compile as K
from quillstone.plans import package as P
from quillstone.sources import discover, jsonl, store
from quillstone.streaming import incremental as I

RECORD = "session_id string, position bigint, id string, kind string, payload string"


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_append_numbers_hashes_and_reads(spark, tmp_path):
    path = str(tmp_path / "log")
    payloads = ["plain é", '{"text": "b", "a": [1, 2.5, null]}', '"quoted"', None, "[not json"]
    rows = [("s", i, f"r{i}", "message", p) for i, p in enumerate(payloads)] + [("t", 0, "x", "message", "y")]
    assert store.append(spark, path, spark.createDataFrame(rows, RECORD)) == 6
    assert store.append_one(spark, path, "s", "r0", "again") == 1
    log = store.read_log(spark, path)
    got = {(r["session_id"], r["seq"]): r for r in log.collect()}
    assert sorted(got) == [("s", i) for i in range(6)] + [("t", 0)] and got["s", 5]["id"] == "r0"
    for i, p in enumerate(payloads):
        held = json.loads(p) if p and p.startswith("{") else p
        body = {"id": f"r{i}", "kind": "message", "payload": held, "seq": i}
        assert got["s", i]["hash"] == hashlib.sha256(dumped(body).encode()).hexdigest()
        line = store.record_lines(log).where(f"session_id = 's' and seq = {i}").first()["line"]
        assert json.loads(line) == body | {"hash": got["s", i]["hash"]} and line == dumped(json.loads(line))
    assert L.verify(log).count() == 0 and store.read_seq(log, "s", 1).count() == 1
    with pytest.raises(IndexError):
        store.read_seq(log, "s", 9)
    with pytest.raises(ValueError):
        store.read_seq(log.withColumn("payload", F.lit("z")), "s", 1)
    with pytest.raises(ValueError):
        store.append(spark, path, spark.createDataFrame([("s", 0, None, "k", "p")], RECORD))
    assert store.read_log(spark, str(tmp_path / "none")).count() == 0


def test_import_rows_mint_ids(spark):
    events = spark.createDataFrame([(3, "a", "user_message", "x"), (7, None, "user_message", "y"), (9, "", "other", "z")], "position bigint, source_id string, type string, payload string")
    got = [r["id"] for r in store.import_rows(events, "s", "file").orderBy("position").collect()]
    key = hashlib.sha256(b"file").hexdigest()[:24]
    assert got == ["a", f"synth-{key}-00000001", f"synth-{key}-00000002"]


def test_torn_last_line_goes(spark):
    lines = spark.createDataFrame([(0, '{"a": 1}'), (1, "{broken"), (2, '{"b": 2}'), (3, '{"c')], "position int, line string")
    assert sorted(r["position"] for r in store.complete_lines(lines).collect()) == [0, 1, 2]
    assert store.complete_lines(lines.where("position < 3")).count() == 3 and store.complete_lines(lines.where("false")).count() == 0


def test_results_packages_and_state_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), ("b", "x", None)], "scenario_id string, status string, n int")
    store.write_results(rows, str(tmp_path / "r"))
    store.write_results(rows, str(tmp_path / "r"), "append")
    assert store.read_results(spark, str(tmp_path / "r"), "scenario_id string, status string, n int").count() == 4
    package = {"manifest": {"format_version": 1}, "state": ["é", None]}
    store.write_package(spark, package, str(tmp_path / "p"))
    assert store.read_package(spark, str(tmp_path / "p")) == package
    for bad in ({"state": 1}, {"manifest": {"format_version": 2}}, {"manifest": {}}):
        store.write_package(spark, bad, str(tmp_path / "bad"))
        with pytest.raises(ValueError):
            store.read_package(spark, str(tmp_path / "bad"))
    folder = str(tmp_path / "state")
    assert store.load_state(spark, folder, "s") == (0, [])
    store.save_state(spark, folder, "s", 4, [{"id": "i"}])
    last = store.save_state(spark, folder, "s", 9, [{"id": "i"}, {"id": "j"}])
    assert store.load_state(spark, folder, "s") == (9, [{"id": "i"}, {"id": "j"}]) and store.load_state(spark, folder, "t") == (0, [])
    spark.createDataFrame([("{no",)], "value string").write.mode("overwrite").text(last)
    assert store.load_state(spark, folder, "s") == (0, [])


def test_identifiers_and_times_by_type(spark):
    lines = ['{"id": true, "timestamp": "1700000000"}', '{"id": 1.5, "timestamp": 1700000000.5}', '{"id": 12, "timestamp": "2024-01-01T00:00:00+02:00"}', '{"id": null, "uuid": "u", "timestamp": true}', '{"id": "", "role": "developer"}']
    got = jsonl.normalize(spark.createDataFrame(list(enumerate(lines)), "position int, line string")).orderBy("position").collect()
    assert [r["source_id"] for r in got] == [None, None, "12", "u", ""]
    assert [r["timestamp"] and r["timestamp"].timestamp() for r in got][1] == 1700000000.5 and [r["timestamp"] is None for r in got] == [True, False, False, True, True]
    assert got[4]["type"] == "developer_message"


def test_agent_events(spark):
    records = [
        {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"content": "ask"}},
        {"type": "assistant", "uuid": "2", "parentUuid": "1", "message": {"content": [{"type": "text", "text": "say"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c", "name": "ls", "input": {"b": 1, "a": 2}}]}},
        {"type": "assistant", "uuid": "3", "message": {"content": [{"type": "thinking", "thinking": "a"}, {"type": "thinking", "thinking": "b"}]}},
        {"type": "user", "uuid": "4", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "uuid": "5", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}]}, {"type": "text", "text": " "}]}},
    ]
    lines = [json.dumps(r) for r in records] + ["", "nope"]
    df = jsonl.agent_events(spark.createDataFrame(list(enumerate(lines)), "position int, line string"))
    got = sorted((r["position"], r["block"], r["reason"] or r["type"], r["text"]) for r in df.where("reason is null").collect())
    assert got == [(0, 0, "user_message", "ask"), (1, 0, "assistant_message", "say"), (1, 2, "tool_call", '{"a":2,"b":1}'), (2, 0, "assistant_message", ""), (4, 0, "tool_result", "x\ny")]
    rows = {(r["position"], r["block"]): r for r in df.collect()}
    assert rows[0, 0]["metadata"] == {"cwd": "/w"} and rows[2, 0]["thinking"] == 2 and rows[1, 2]["tool_name"] == "ls" and rows[1, 2]["tool_call_id"] == rows[4, 0]["tool_call_id"] == "c"
    assert rows[5, 0]["reason"] == "blank" and rows[6, 0]["reason"] == "invalid_json"
    asked = jsonl.agent_events(spark.createDataFrame(list(enumerate(lines)), "position int, line string"), thinking=True)
    assert sorted(r["text"] for r in asked.where("position = 2").collect()) == ["a", "b"]


def test_discovery_and_survey(spark, tmp_path):
    (tmp_path / "a").mkdir()
    agent = [{"type": "custom-title", "sessionId": "s"}, *({"type": "user" if i % 2 else "assistant", "uuid": str(i), "parentUuid": str(i - 1) if i else None, "sessionId": "s", "message": {"content": f"turn {i}"}} for i in range(6))]
    (tmp_path / "a" / "one.jsonl").write_text("\n".join(map(json.dumps, agent)))
    (tmp_path / "a" / "two.jsonl").write_text('{"id": "a", "role": "user", "content": "hi"}\n')
    assert discover.sessions(spark, str(tmp_path)).count() == 2 and discover.sessions(spark, str(tmp_path), 1).count() == 1
    one = str(tmp_path / "a" / "one.jsonl")
    assert discover.importer_for(discover.sample_lines(spark, one)) == "agent" and discover.importer_for(['{"id": 1']) == "generic"
    assert not discover.looks_agent(['{"type": "user"}', '{"type": "strange", "sessionId": 1}']) and not discover.looks_generic(["[1]"])
    with pytest.raises(ValueError):
        discover.importer_for(["text"])
    said = discover.survey(discover.events_of(spark, one).where("reason is null"), tail=2).collect()
    assert [r["turn"]["content"] for r in said] == ["turn 4", "turn 5"] and [r["turn"]["role"] for r in said] == ["assistant", "user"]
    paths = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/q",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert sorted(tuple(r) for r in discover.project_root(paths, roots).collect()) == [("/a/b/c", "/a/b"), ("/a/x", "/a"), ("/q", "/q")]


def test_cycles_raise(spark):
    rows = [("s", 0, "a", "b"), ("s", 1, "b", "a"), ("s", 2, "c", None)]
    with pytest.raises(ValueError):
        H.live(spark.createDataFrame(rows, "session_id string, seq int, id string, parent_id string")).collect()


def test_verify_reports_missing_hashes(spark):
    log = store.with_hash(spark.createDataFrame([("s", 0, "a", "k", "x"), ("s", 1, "b", "k", "y"), ("s", 3, "c", "k", None)], "session_id string, seq bigint, id string, kind string, payload string"))
    damaged = log.withColumn("hash", F.when(F.col("seq") != 0, F.col("hash")))
    assert sorted(r["seq"] for r in L.verify(damaged).collect()) == [0, 3]


def test_search_reads_json_payloads_and_filters(spark):
    rows = [("s", 0, "a", "m", '{"type": "tool_result", "tool_name": "ls", "text": "port 8082"}'), ("s", 1, "b", "m", '{"type": "user_message", "content": "port"}'), ("t", 0, "c", "m", "the port 8082")]
    log = spark.createDataFrame(rows, "session_id string, seq int, id string, kind string, payload string")
    assert {r["id"] for r in search(log, "port", 9).collect()} == {"a", "b", "c"}
    assert [r["id"] for r in search(log, "port", 9, tools=["ls"]).collect()] == ["a"] and [r["id"] for r in search(log, "port", 9, types=["user_message"]).collect()] == ["b"]
    assert {r["id"] for r in search(log, "8082", 1, per="session_id").collect()} == {"a", "c"} and search(log, "type", 9).count() == 0
    got = [r[0] for r in log.orderBy("id").select(render.package_excerpt(F.col("payload"))).collect()]
    assert got == ["port 8082", "port", "the port 8082"]


def test_labels(spark):
    texts = ["the write timeout is 74 seconds. Host 10.0.0.5:80 was set", "utf8 and v2 take 4,700 rows", "47", "retry: 0x1F, 1 or 2"]
    log = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, seq int, payload string")
    got = [(r["value"], r["label"]) for r in X.literals(log).orderBy("n").collect()]
    assert got == [("74", "write timeout (seconds)"), ("10.0.0.5:80", "Host"), ("4,700", "v2 take (rows)")]
    ledger = X.literals(log)
    kept = spark.createDataFrame([("s", "now 174 and 74.5"), ("s", "10.0.0.5:80."), ("s", "4,700!")], "session_id string, payload string")
    assert sorted(r["value"] for r in X.missing_literals(ledger, kept).collect()) == ["10.0.0.5:80", "74"]


def test_parse_items_and_report(spark):
    items = [{"type": "Fact", "content": " port is 80 ", "source_ids": ["a", "zz"], "confidence": 3}, {"type": "decision", "content": "x", "source_ids": ["a"]}, {"type": "odd", "content": "x", "source_ids": ["a"]}, {"type": "fact", "content": "x", "source_ids": ["zz"]}, {"type": "fact", "content": ""}, 7, {"type": "goal", "content": "g", "source_ids": ["a"], "status": "nope", "confidence": True}]
    replies = spark.createDataFrame([("r1", "s", "<think>hm</think>```json\n" + json.dumps({"items": items}) + "\n```"), ("r2", "s", "sorry")], "reply_id string, session_id string, text string")
    log = spark.createDataFrame([("s", 0, "a")], "session_id string, seq int, id string")
    parsed = X.parse_items(replies, log)
    got = {(r["reply_id"], r["n"]): r for r in parsed.collect()}
    assert [got["r1", i]["reason"] for i in range(7)] == [None, "decision_without_rationale", "unknown_type", "unattributed", "no_content", "not_an_object", None]
    assert got["r2", 0]["reason"] == "malformed_response" and got["r1", 0]["cited"] == ["a"] and got["r1", 0]["confidence"] == 1.0 and got["r1", 6]["status"] == "active" and got["r1", 6]["confidence"] == 0.5
    report = {r["reply_id"]: r for r in X.extraction_report(parsed).collect()}
    assert (report["r1"]["emitted"], report["r1"]["accepted"], report["r1"]["rejected"], report["r1"]["unattributed"], report["r1"]["unknown_types"], report["r1"]["malformed"]) == (7, 2, 5, 1, 1, False) and report["r2"]["malformed"]


def test_item_findings(spark):
    schema = "id string, session_id string, expected_session string, type string, rationale string, supersedes string"
    items = spark.createDataFrame([("a", "s", "t", "decision", " ", None), ("b", "s", "s", "fact", None, "gone"), ("c", "u", "u", "fact", None, "d"), ("d", "u", "u", "fact", None, "c")], schema)
    got = sorted((r["id"], r["code"]) for r in X.item_findings(items, items.limit(0).select("id")).collect())
    assert got == [("a", "decision_without_rationale"), ("a", "wrong_session"), ("b", "supersedes_unknown_item"), ("c", "everything_superseded")]


def test_compaction_runs(spark):
    rows = [("a", 0, "k", "short one"), ("b", 0, "k", "port 8080 " + "x " * 150), ("b", 1, "k", "y " * 20), ("b", 2, "k", "z " * 15)]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, kind string, payload string")
    made = C.compact(log, 100, lambda t: "sum " * 90, ledger=True).collect()
    got = {r["session_id"]: r for r in made}
    assert got["a"]["summary"] is None and got["a"]["from_seq"] == 0
    assert got["b"]["from_seq"] == 2
    assert got["b"]["fallback"] == "cut_summary" and len(got["b"]["summary"].split()) <= 100
    chunks = {(r["session_id"], r["seq"]): r["chunk"] for r in C.history_chunks(log, 30).collect()}
    assert chunks["b", 0] == 0 and chunks["b", 1] == 1 and chunks["b", 2] == 2
    sums = spark.createDataFrame([("b", "s1 s2")], "session_id string, summary string")
    recent = spark.createDataFrame([("b", 0, 60), ("b", 1, 40), ("b", 2, 30)], "session_id string, seq bigint, cost bigint")
    r = C.enforce(sums, recent, 100).first()
    assert (r["summary"], r["from_seq"], r["fallback"]) == (None, 1, "dropped_recent")
    state, rest = C.hybrid(spark.createDataFrame([], "session_id string, id string, type string, content string, rationale string, status string, created_at int"), log, 160, lambda t: "s")
    assert state.count() == 0 and rest.count() == 2
    with pytest.raises(ValueError):
        C.hybrid(state, log, 40, lambda t: "s")


def test_compile_all_sections(spark):
    log = spark.createDataFrame([("s", i, f"r{i}", "user_message", f"turn {i} about port 80{i}") for i in range(6)], "session_id string, seq bigint, id string, kind string, payload string")
    schema = "session_id string, id string, type string, content string, rationale string, status string, created_at int"
    items = spark.createDataFrame([("s", "g", "goal", "ship it", None, "active", 1), ("s", "d", "decision", "use x", "fast", "active", 2), ("s", "o", "preference", "p", None, "active", 3)], schema)
    old = spark.createDataFrame([("s", "h", "constraint", "no sudo", None, "active", 1)], schema)
    proof = spark.createDataFrame([("s", "g", "turn 0 about port 800"), ("s", "d", None)], "session_id string, item_id string, excerpt string")
    got = K.compile_context(items, log, "find port 803", 90, inherited=old, evidence=proof, retrieve=2, frame=True).collect()
    cost = {}
    for r in got:
        cost.setdefault(r["section"], []).append((r["id"], r["cost"]))
    assert sorted(cost["state"]) == [("d", 6), ("g", 4)] and cost["inherited"] == [("h", 4)] and cost["evidence"] == [("g", 7)]
    assert [i for i, _ in sorted(cost["retrieved"])][-1] == "r3" and sum(c for v in cost.values() for _, c in v) <= 90 - 3 - len(K.FRAME.split())
    with pytest.raises(ValueError):
        K.compile_context(items, log, "one two three", 2)
    built = K.build(items.withColumns({"sources": F.array(F.lit("r2"), F.lit("no")), "retention": F.lit("durable"), "supersedes": F.lit(None).cast("string")}), store.with_hash(log))
    r = built.first()
    assert r["package_id"].startswith("ctx_") and r["evidence"][0]["seqs"] == [2] and list(r["archive"]["record_hashes"]) == [2] and len(r["recent"]) == 6 and "3 state items" in K.inspect(built).first()["summary"]
    again = built.select(K.content_hash(F.struct("session_id", "format_version", "state", "evidence", "archive", "recent")).alias("h")).first()["h"]
    assert again == r["content_hash"]


def test_package_rules(spark):
    packages = spark.createDataFrame([("p", "s", 1, 1, "h", "h", "s", {0: "x"}), ("q", "t", 1, 1, "h", "h", "t", None)], "package_id string, session_id string, format_version int, state_version int, content_hash string, expected_hash string, archive_session_id string, record_hashes map<bigint,string>")
    items = spark.createDataFrame([("q", "a", "t", "active", None), ("q", "a", "t", "active", None)], "package_id string, id string, session_id string, status string, supersedes string")
    proof = spark.createDataFrame([("q", "a", [0])], "package_id string, item_id string, seqs array<bigint>")
    found = P.validate(packages, items, proof)
    assert sorted((r["package_id"], r["code"]) for r in found.collect()) == [("q", "duplicate_state"), ("q", "no_archive_reference")]
    assert sorted(tuple(r) for r in P.report(found, packages).collect()) == [("p", 0, 0, True), ("q", 1, 1, False)]
    assert [r["severity"] for r in P.ordered(found).collect()] == ["error", "warning"]
    places = spark.createDataFrame([("p", "/tmp/x"), ("q", "archive")], "id string, location string")
    assert [r["id"] for r in P.absolute_locations(places).collect()] == ["p"]


def test_incremental_extraction(spark):
    log = spark.createDataFrame([("s", i, f"r{i}", "m", f"p{i}") for i in range(5)] + [("t", 0, "x", "m", "bad"), ("u", 0, "y", "m", "done")], "session_id string, seq bigint, id string, kind string, payload string")
    marks = spark.createDataFrame([("s", 2), ("u", 1)], "session_id string, next_seq bigint")
    known = spark.createDataFrame([("s", "k")], "session_id string, content string")

    def extractor(records, before):
        return None if any(r["payload"] == "bad" for r in records) else [{"content": f"{len(records)} after {len(before)}"}]

    got = {r["session_id"]: r for r in I.extract_new(log, marks, known, extractor, window=2).collect()}
    assert set(got) == {"s", "t"} and got["s"]["next_seq"] == 5 and json.loads(got["s"]["items"]) == [{"content": "2 after 1"}, {"content": "1 after 2"}]
    assert got["t"]["ok"] is False and got["t"]["next_seq"] is None
    kept = I.merge_extracted(known, spark.createDataFrame([("s", "n"), ("t", "n")], "session_id string, content string"), spark.createDataFrame([("t",)], "session_id string"))
    assert sorted(tuple(r) for r in kept.collect()) == [("s", "k"), ("s", "n")]
    waits, left = [], [plugins.RateLimited(wait=99), plugins.RateLimited(), None]

    def call():
        e = left.pop(0)
        if e:
            raise e
        return "ok"

    assert I.retrying(call, sleep=waits.append)() == "ok" and waits == [30.0, 2.0]
    with pytest.raises(plugins.RateLimited):
        I.retrying(lambda: (_ for _ in ()).throw(plugins.RateLimited()), times=1, sleep=waits.append)()


def test_hooks_and_resume(spark, tmp_path):
    texts = ['{"hook_event_name": "PreCompact", "trigger": "auto", "transcript_path": "/t", "session_id": "s"}', "no json", '{"hook_event_name": "PreCompact", "trigger": "manual", "transcript_path": "/t"}', '{"hook_event_name": "PreCompact", "trigger": "auto"}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(I.hook_event(F.col("t")).alias("e")).select(I.capture_reason(F.col("e"), F.lit(10), least=5)).collect()]
    assert got == [None, "not a compaction event (unknown)", "requested by the user, not by pressure", "the event named no transcript"]
    planned = spark.createDataFrame([("a", 1), ("b", 1)], "scenario_id string, n int")
    path, ran = str(tmp_path / "done"), []

    def run(df):
        ran.append(sorted(r["scenario_id"] for r in df.collect()))
        return df

    assert I.resume(planned.limit(1), path, ["scenario_id"], run).count() == 1 and I.resume(planned, path, ["scenario_id"], run).count() == 2
    assert ran == [["a"], ["b"]]


def test_plugins():
    with pytest.raises(KeyError):
        plugins.judges.get("none")
    with pytest.raises(ValueError):
        plugins.scorers.add("lexical", None)
    fake = plugins.Fake(["one"], fixed="rest")
    limited = plugins.Limited(fake, 2)
    assert [limited("q"), limited("q")] == ["one", "rest"] and fake.requests == ["q", "q"]
    with pytest.raises(plugins.BudgetExhausted):
        limited("q")
    judge = plugins.model_judge(plugins.Fake(["\n**Yes.**", "maybe"]))
    assert judge("q", "r") is True and judge("q", "r") is None and plugins.model_judge(plugins.Failing())("q", "r") is None
    assert isinstance(plugins.error_for(429), plugins.RateLimited) and isinstance(plugins.error_for(503), plugins.ProviderUnavailable) and isinstance(plugins.error_for(422), plugins.InvalidRequest)
    with pytest.raises(RuntimeError):
        plugins.unavailable("no vocabulary")(None)


def test_judges_units_and_ratios(spark):
    df = spark.createDataFrame([("q1", "Use Redis"), ("q1", "no"), ("q2", "x")], "q string, r string")
    assert [r[0] for r in df.select(plugins.keyword_judge({"q1": ["redis"]})(F.col("q"), F.col("r"))).collect()] == [True, False, None]
    one = spark.range(1)
    got = one.select(T.unit(F.lit(True)), T.unit(F.lit("7")), T.unit(F.lit("x")), parse.ratio(F.lit(4), F.lit(2)), parse.ratio(F.lit(4), F.lit(0)), parse.ratio(F.lit(0), F.lit(0)), parse.ratio(F.lit(4), F.lit(0), False), E.total_tokens(F.lit(None).cast("int"), F.lit(3)), E.total_tokens(F.lit(None).cast("int"))).first()
    assert tuple(got) == (0.5, 1.0, 0.5, 2.0, float("inf"), 1.0, None, 3, None)
    think = one.select(parse.strip_reasoning(F.lit("a</think>b<think>c</think>d<think>e")), parse.strip_fence(F.lit(" ```\nx\n``` ")), parse.strip_fence(F.lit("x ``` y"))).first()
    assert tuple(think) == ("bd", "x", "x ``` y")


def test_state_codecs_and_batches(spark, tmp_path):
    items = spark.createDataFrame([("a", "s", "decision", "why", None), ("b", "s", "fact", None, "sub")], "id string, session_id string, type string, rationale string, subject string")
    rows = S.to_row(items)
    assert rows.columns == ["id", "session_id", "type", "attributes"] and sorted(map(tuple, S.from_row(rows, "rationale string, subject string").collect())) == sorted(map(tuple, items.collect()))
    path = str(tmp_path / "items")
    none = spark.createDataFrame([], "id string, code string")
    S.insert(items.limit(0), items, path, none)
    stored = spark.read.parquet(path)
    for batch, check in ((items, none), (items.unionByName(items).withColumn("id", F.lit("n")), none), (items.withColumn("id", F.concat("id", F.lit("2"))), spark.createDataFrame([("a2", "bad")], "id string, code string"))):
        with pytest.raises(ValueError):
            S.insert(stored, batch, path, check)
    assert spark.read.parquet(path).count() == 2
    refs = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x")], "id string, ordinal int, reference string")
    assert {r["id"]: r["sources"] for r in S.hydrated(items.select("id"), refs).collect()} == {"a": ["x", "y"], "b": []}
    assert S.listed(items.withColumn("created_at", F.lit(1)), "s", []).count() == 0


def test_integrity_report(spark):
    sessions = spark.createDataFrame([("s",)], "id string")
    messages = spark.createDataFrame([("m", "s", 0, None), ("m", "s", 0, "gone"), ("n", "lost", 1, "m")], "id string, session_id string, seq int, parent_id string")
    items = spark.createDataFrame([("i", "s", "decision", "critical", ["e", "f"], "zz", ["i"], None, "blocked", None)], "id string, session_id string, type string, retention string, sources array<string>, supersedes string, related_ids array<string>, rationale string, task_status string, blocked_by array<string>")
    evidence = spark.createDataFrame([("e", "x", hashlib.sha256(b"x").hexdigest(), ["m"])], "id string, content string, content_hash string, source_ids array<string>")
    snaps = spark.createDataFrame([("p", "s", "p", ["a", "a"], ["a"], [])], "id string, session_id string, parent_snapshot_id string, active_message_ids array<string>, archived_message_ids array<string>, state_item_ids array<string>")
    got = {(r["relation"], r["code"]) for r in G.integrity_report(sessions, messages, items, evidence, snaps).collect()}
    assert got == {("messages", "repeated_id"), ("messages", "repeated_place"), ("messages", "unknown_session"), ("messages", "unknown_parent"), ("items", "unknown_superseded"), ("items", "unknown_source"), ("items", "relates_to_itself"), ("items", "decision_without_rationale"), ("items", "blocked_without_blocker"), ("snapshots", "own_parent"), ("snapshots", "repeated_active"), ("snapshots", "active_and_archived")}


def test_evaluation_runs(spark):
    cells = spark.createDataFrame([("a", "ctx"), ("b", ""), ("c", "boom")], "scenario_id string, context string")

    def run(row):
        if row["context"] == "boom":
            raise plugins.ProviderUnavailable("down")
        return row["context"].upper()

    got = {r["scenario_id"]: (r["response"], r["status"]) for r in E.run_cells(cells, run).collect()}
    assert got == {"a": ("CTX", "success"), "b": (None, "context_error"), "c": (None, "model_error")}
    noise = [tuple(r) for r in E.noise(spark, ["t0", "t1"], ["p0"], ["n0", "n1"], 4).orderBy("seq").collect()]
    assert noise == [(0, "user", "What about t0?"), (1, "assistant", "p0: n0"), (2, "user", "What about t1?"), (3, "assistant", "p0: n1")]
    checks = spark.createDataFrame([("s", "c", "fact", ["x"], None, ["y", "z"]), ("s", "d", "fact", None, None, ["w"])], "scenario_id string, check_id string, category string, required array<string>, required_any array<string>, forbidden array<string>")
    split = sorted((r["check_id"], r["kind"]) for r in E.absence_to_questions(checks).collect())
    assert split == [("c", "check"), ("c", "question"), ("d", "question")]
    held = spark.range(1).select(E.holds(F.lit("Use Redis, not SQL"), F.array(F.lit("redis")), F.array(F.lit("x"), F.lit("sql")), F.array(F.lit("mongo"))), E.holds(F.lit("Use Redis"), F.array(F.lit("redis")), F.lit(None).cast("array<string>"), F.array(F.lit("REDIS")), case=True)).first()
    assert tuple(held) == (True, False)
    matrix = E.matrix(spark.createDataFrame([("s",)], "scenario_id string"), ["full", "sum"], [100], "full", 2)
    assert E.requests(matrix, {"sum": 2}, spark.createDataFrame([("s", 3)], "scenario_id string, questions int")).first()[0] == 2 * (1 + 3) + 2 * (2 + 3)
    runs = spark.createDataFrame([("r", "m", {"model": "m"}), ("q", "m", {"model": "n"})], "run_id string, model string, fingerprint map<string,string>")
    assert [tuple(r) for r in E.mirrors(runs, ["model"]).collect()] == [("q", "model")]
    modes = spark.createDataFrame([("a", "success", ["x", "y"], True), ("a", "success", ["x"], None)], "strategy string, status string, failure_modes array<string>, completed boolean")
    assert sorted(tuple(r) for r in E.mode_completion(modes).collect()) == [("a", "x", 1, 1), ("a", "y", 1, 1)]
