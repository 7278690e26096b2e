"""The engine's queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import ids as ID
from quillstone.functions import parse as PA
from quillstone.functions import render as R
from quillstone.functions import text as T
from quillstone.functions.canonical import content_hash
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
from quillstone.plans.compaction import compaction_plan as plan_compaction
from quillstone.sources import store as W
from quillstone.sources.tables import archive, results, state_items, table, thread
from quillstone.streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Canonical JSON text of a string: ASCII with escapes.
JSON_TEXT = r"""('"' || array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
 WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE printf('\u%04x', unicode(c)) END), '') || '"')"""
HASHED = f"""sha256('{{{{"id":"' || conv_id || '-' || turn || '","kind":"' || role || '_message","payload":' || {JSON_TEXT.format('text')} || ',"seq":' || turn || '}}}}')""".replace("{{", "{").replace("}}", "}")
ARCHIVE = f"archive AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, conv_id || '-' || turn AS id, role || '_message' AS kind, text AS payload, {HASHED} AS hash FROM conversations)"
THREAD = f"{ARCHIVE}, thread AS (SELECT *, CASE WHEN seq IN (0, 5) THEN NULL WHEN seq % 3 = 0 THEN session_id || '-' || (seq - 2) ELSE session_id || '-' || (seq - 1) END AS parent_id FROM archive)"
STATE = """state AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id,
 CASE event_type WHEN 'click' THEN 'fact' WHEN 'error' THEN 'constraint' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'goal' ELSE 'task' END AS type,
 event_type || ' ' || props AS content, CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN event_id % 13 = 0 THEN 'critical' WHEN event_id % 5 = 0 THEN 'ephemeral' ELSE 'durable' END AS retention,
 CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS subject, ts AS created_at,
 CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'paid ' || props END AS rationale, CASE WHEN value > 40 THEN CAST(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS VARCHAR) END AS supersedes FROM events)"""
RESULTS = """results AS (SELECT CAST(doc_id AS VARCHAR) AS scenario_id, lang AS strategy, CASE WHEN n_chars < 1000 THEN 160 WHEN n_chars < 4000 THEN 900 ELSE 2000 END AS budget,
 CASE WHEN doc_id % 10 = 0 THEN 'model_error' ELSE 'success' END AS status, quality = 1 AS passed, CASE WHEN toxic = 1 THEN 'fabricated' WHEN quality = 1 THEN 'passed' ELSE 'omitted' END AS completion,
 CASE WHEN quality = 1 THEN 'fact' ELSE 'constraint' END AS category, CAST(trunc(n_chars / 4) AS BIGINT) AS context_tokens, source AS model FROM documents JOIN labels USING (doc_id))"""
WORDS = r"len(regexp_extract_all({}, '\S+'))"
CURRENT = "current_items AS (SELECT * FROM state s WHERE status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM state t WHERE t.supersedes = s.id))"
LEVEL = "CASE WHEN retention = 'critical' THEN 'project' WHEN retention = 'ephemeral' THEN 'event' WHEN type IN ('goal', 'constraint', 'decision') THEN 'project' ELSE 'session' END"
SEARCH_TERMS = ("est", "la", "thing", "reed", "12")
STATE_COST = f"({WORDS.format('content')} + 1 + coalesce(1 + {WORDS.format('rationale')}, 0) + CASE WHEN k > 1 THEN 0 WHEN type = 'task' THEN 2 ELSE 1 END)"
QUERY = "what is the est of la thing reed 12"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _score_sql() -> str:
    parts, found = [], []
    for t in SEARCH_TERMS:
        n = f"len(list_filter(toks, lambda x: x = '{t}'))"
        weight = (1.0 + min(len(t), 12) / 6.0) * (2.0 if any(c.isdigit() for c in t) else 1.0)
        parts.append(f"CASE WHEN {n} > 0 THEN CAST({weight!r} AS DOUBLE) * (1.0 + ln({n})) ELSE 0.0 END")
        found.append(f"CAST({n} > 0 AS INT)")
    return f"round(({' + '.join(parts)}) * (0.5 + ({' + '.join(found)}) / {float(len(SEARCH_TERMS))!r}), 9)"


TOKS = r"list_transform(regexp_extract_all(payload, '[A-Za-z_]+|\d+(?:\.\d+)*'), lambda x: lower(x))"


def _search_sql(where: str, limit: int) -> str:
    first = "least(" + ", ".join(f"coalesce(nullif(instr(lower(payload), '{t}'), 0), 1000000000)" for t in SEARCH_TERMS) + ")"
    return f"""WITH {ARCHIVE}, t AS (SELECT *, {TOKS} AS toks FROM archive WHERE payload <> '' {where}), s AS (SELECT session_id, seq, id, payload, {_score_sql()} AS score FROM t),
 k AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, seq, session_id LIMIT {limit}), f AS (SELECT *, CASE WHEN {first} = 1000000000 THEN 1 ELSE {first} END AS p FROM k), g AS (SELECT *, greatest(0, p - 81) AS st FROM f)
 SELECT session_id, seq, id, score, CASE WHEN st > 0 THEN '… ' ELSE '' END || array_to_string(regexp_extract_all(substr(payload, CAST(st + 1 AS BIGINT), 240), '\\S+'), ' ') AS excerpt FROM g"""


@query(_search_sql("", 20))
def search_topk(spark, sf):
    return search(archive(spark, sf), QUERY, 20)


@query(_search_sql("AND kind = 'assistant_message' AND seq BETWEEN 1 AND 5", 10))
def search_filtered(spark, sf):
    return search(archive(spark, sf), QUERY, 10, ["assistant_message"], 1, 5)


@query(f"WITH {ARCHIVE} SELECT session_id, seq, CAST(len({TOKS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKS})) AS BIGINT) AS n_distinct FROM archive")
def tokenize_counts(spark, sf):
    own = T.tokens(F.col("payload"))
    return archive(spark, sf).select("session_id", "seq", F.size(own).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(own)).cast("bigint").alias("n_distinct"))


@query(f"WITH {ARCHIVE} SELECT term, count(*) AS n FROM (SELECT unnest({TOKS}) AS term FROM archive) GROUP BY term")
def term_frequency(spark, sf):
    return archive(spark, sf).select(F.explode(T.tokens(F.col("payload"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ARCHIVE} SELECT session_id, seq, id FROM archive WHERE seq >= 1 AND seq < 4")
def archive_range(spark, sf):
    return L.in_range(archive(spark, sf), 1, 4).select("session_id", "seq", "id")


@query(f"WITH {ARCHIVE} SELECT session_id, seq, id FROM archive WHERE seq BETWEEN 2 AND 5")
def archive_window(spark, sf):
    return L.around(archive(spark, sf), 3, 1, 2).select("session_id", "seq", "id")


@query(f"WITH {ARCHIVE} SELECT session_id, seq, id FROM archive a WHERE seq > (SELECT max(seq) FROM archive b WHERE b.session_id = a.session_id) - 3")
def archive_tail(spark, sf):
    return L.tail(archive(spark, sf), 3).select("session_id", "seq", "id")


@query(f"WITH {ARCHIVE} SELECT session_id, seq, CASE WHEN seq = 3 THEN id || 'x' ELSE id END AS id FROM archive WHERE seq IN (1, 3, 5) OR session_id = '7'")
def archive_verify(spark, sf):
    """Changed ids, kinds and payloads, and missing hashes."""
    seq = F.col("seq")
    damaged = archive(spark, sf).withColumns(
        {
            "id": F.when(seq == 3, F.concat("id", F.lit("x"))).otherwise(F.col("id")),
            "kind": F.when(seq == 5, "other").otherwise(F.col("kind")),
            "payload": F.when(seq == 1, F.concat("payload", F.lit("."))).otherwise(F.col("payload")),
            "hash": F.when(F.col("session_id") != "7", F.col("hash")),
        }
    )
    return L.verify(damaged)


@query(f"WITH {ARCHIVE} SELECT session_id, count(*) AS records, max(seq) + 1 AS next_seq, CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM archive GROUP BY session_id")
def session_stats(spark, sf):
    return L.session_sizes(archive(spark, sf))


@query(f"WITH {ARCHIVE} SELECT kind, count(*) AS n, CAST(sum(ceil(length(payload) / 4.0)) AS BIGINT) AS char_tokens FROM archive GROUP BY kind")
def event_type_counts(spark, sf):
    return archive(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(T.char_tokens(F.col("payload"))).alias("char_tokens"))


@query(f"WITH {ARCHIVE} SELECT session_id, CAST(sum({WORDS.format('payload')} + 3) AS BIGINT) AS tokens FROM archive GROUP BY session_id")
def conversation_tokens(spark, sf):
    return archive(spark, sf).groupBy("session_id").agg(F.sum(T.word_count(F.col("payload")) + 3).alias("tokens"))


@query(f"WITH {ARCHIVE}, c AS (SELECT *, {WORDS.format('payload')} + 3 AS cost FROM archive), r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY seq DESC) AS spent FROM c) SELECT session_id, seq, CAST(cost AS BIGINT) AS cost, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 200")
def recent_window(spark, sf):
    return L.recent_window(archive(spark, sf), 200).select("session_id", "seq", "cost", "spent")


@query(
    f"""WITH RECURSIVE {ARCHIVE}, z AS (SELECT session_id, seq, length(payload) AS size FROM archive),
 w AS (SELECT session_id, seq, 0 AS win, size AS used FROM z WHERE seq = 0 UNION ALL SELECT z.session_id, z.seq, CASE WHEN w.used + z.size > 900 AND w.used > 0 THEN w.win + 1 ELSE w.win END, CASE WHEN w.used + z.size > 900 AND w.used > 0 THEN z.size ELSE w.used + z.size END FROM w JOIN z ON z.session_id = w.session_id AND z.seq = w.seq + 1)
 SELECT session_id, seq, CAST(win AS BIGINT) AS "window" FROM w"""
)
def greedy_windows(spark, sf):
    return L.greedy_windows(archive(spark, sf), F.length("payload"), 900)


@query(f"WITH {THREAD} SELECT session_id, seq, CAST(sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS segment FROM thread")
def segments(spark, sf):
    return L.segments(thread(spark, sf)).select("session_id", "seq", "segment")


_LIVE = f"""WITH RECURSIVE {THREAD}, up AS (SELECT id, id AS cur, parent_id FROM thread UNION ALL SELECT u.id, t.id, t.parent_id FROM up u JOIN thread t ON t.id = u.parent_id), roots AS (SELECT id, cur AS root FROM up u WHERE NOT EXISTS (SELECT 1 FROM thread t WHERE t.id = u.parent_id)),
 leaves AS (SELECT r.root, arg_max(t.id, t.seq) AS leaf FROM roots r JOIN thread t ON t.id = r.id GROUP BY r.root), live AS (SELECT DISTINCT u.cur AS id FROM leaves l JOIN up u ON u.id = l.leaf)"""


@query(f"{_LIVE} SELECT session_id, seq, id FROM thread WHERE id IN (SELECT id FROM live)")
def active_thread(spark, sf):
    return H.live(thread(spark, sf)).select("session_id", "seq", "id")


@query(f"{_LIVE} SELECT session_id, seq, id FROM thread WHERE id NOT IN (SELECT id FROM live)")
def abandoned_events(spark, sf):
    return H.abandoned(thread(spark, sf)).select("session_id", "seq", "id")


@query("SELECT count(*) AS events, CAST(0 AS BIGINT) AS missing_ids, count(*) - count(DISTINCT conv_id || '-' || (turn // 2)) AS duplicates, CAST(0 AS BIGINT) AS missing_timestamps, count(*) FILTER (WHERE role = 'system') AS unknown_types, min(turn) AS first_seq, max(turn) AS last_seq FROM conversations")
def import_counters(spark, sf):
    c = table(spark, sf, "conversations")
    return L.import_counters(c.select(F.concat_ws("-", "conv_id", F.expr("turn div 2")).alias("id"), F.when(F.col("role") == "system", "other").otherwise(F.col("role")).alias("kind"), F.lit(0).alias("timestamp"), F.col("turn").alias("seq")))


@query("WITH x AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'tool_call' ELSE 'tool_result' END AS kind, user_id AS call_id FROM events), y AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a FROM x WINDOW w AS (PARTITION BY call_id ORDER BY event_id)) SELECT event_id AS position, kind, CASE WHEN kind = 'tool_result' THEN coalesce(b = 'tool_call', false) ELSE coalesce(a = 'tool_result', false) END AS matched FROM y")
def tool_pairing(spark, sf):
    e = table(spark, sf, "events")
    calls = e.select(F.col("event_id").alias("position"), F.when(F.col("event_type").isin("click", "view"), "tool_call").otherwise("tool_result").alias("kind"), F.col("user_id").alias("call_id"))
    return L.tool_pairs(calls).select("position", "kind", "matched")


@query(f"WITH {STATE}, {CURRENT} SELECT id, session_id, type FROM current_items")
def current_state(spark, sf):
    return S.current(state_items(spark, sf)).select("id", "session_id", "type")


@query(f"WITH {STATE} SELECT supersedes AS id, arg_min(id, created_at) AS successor FROM state WHERE supersedes IS NOT NULL GROUP BY supersedes")
def superseded_by(spark, sf):
    return S.successors(state_items(spark, sf))


@query(
    f"""WITH RECURSIVE {STATE}, nx AS (SELECT supersedes AS id, arg_min(id, created_at) AS succ FROM state WHERE supersedes IS NOT NULL GROUP BY supersedes),
 c AS (SELECT id, id AS newest, CAST(0 AS BIGINT) AS steps FROM state UNION ALL SELECT c.id, nx.succ, c.steps + 1 FROM c JOIN nx ON nx.id = c.newest) SELECT id, arg_max(newest, steps) AS newest, max(steps) AS steps FROM c GROUP BY id"""
)
def supersession_chain(spark, sf):
    return S.newest(state_items(spark, sf)).select("id", "newest", "steps")


@query(f"WITH {STATE} SELECT session_id, type, lower(trim(content)) AS content, count(*) AS n, min(id) AS first_id FROM state WHERE status = 'active' GROUP BY ALL HAVING count(*) > 1")
def duplicate_active(spark, sf):
    return S.duplicate_active(state_items(spark, sf))


@query(f"WITH {STATE} SELECT session_id, subject, contents, n FROM (SELECT '0' AS session_id, lower(trim(subject)) AS subject, count(DISTINCT lower(trim(content || session_id))) AS contents, count(*) AS n FROM state WHERE status = 'active' AND type = 'fact' AND trim(subject) <> '' GROUP BY 2) WHERE contents > 1")
def contradictory_facts(spark, sf):
    items = state_items(spark, sf)
    return S.contradictory_facts(items.withColumn("content", F.concat("content", "session_id")).withColumn("session_id", F.lit("0")))


@query(f"WITH {STATE}, x AS (SELECT CASE WHEN id LIKE '%3' THEN '100' ELSE supersedes END AS supersedes FROM state) SELECT supersedes, count(*) AS n FROM x WHERE supersedes IS NOT NULL GROUP BY supersedes HAVING count(*) > 1")
def supersession_forks(spark, sf):
    items = state_items(spark, sf)
    return S.supersession_forks(items.withColumn("supersedes", F.when(F.col("id").like("%3"), "100").otherwise(F.col("supersedes"))))


_HALVES = "ex AS (SELECT * FROM state WHERE CAST(id AS BIGINT) % 2 = 0), inc AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 5 = 1 THEN content WHEN CAST(id AS BIGINT) % 5 = 3 THEN 'nothing ' || id END AS claim FROM state WHERE CAST(id AS BIGINT) % 2 = 1)"


@query(
    f"""WITH {STATE}, {_HALVES}, known AS (SELECT session_id, type, lower(content) AS c, arg_max(id, (created_at, id)) AS stored FROM ex GROUP BY 1, 2, 3), arr AS (SELECT DISTINCT session_id, type, lower(content) AS c FROM inc)
 SELECT i.session_id, i.id, CASE WHEN claim IS NOT NULL AND stored IS NOT NULL THEN 'supersedes' WHEN claim IS NOT NULL AND arr.c IS NOT NULL THEN 'added' WHEN claim IS NOT NULL THEN 'supersedes_missing' WHEN stored IS NOT NULL THEN 'unchanged' ELSE 'added' END AS action, stored AS target
 FROM inc i LEFT JOIN known k ON k.session_id = i.session_id AND k.type = i.type AND k.c = lower(coalesce(claim, content)) LEFT JOIN arr ON arr.session_id = i.session_id AND arr.type = i.type AND arr.c = lower(coalesce(claim, content))"""
)
def reconcile_plan(spark, sf):
    items, n = state_items(spark, sf), F.col("id").cast("bigint")
    claim = F.when(n % 5 == 1, F.col("content")).when(n % 5 == 3, F.concat(F.lit("nothing "), "id"))
    return S.reconcile(items.where(n % 2 == 0), items.where(n % 2 == 1).withColumn("claim", claim))


@query(f"WITH {STATE} SELECT {LEVEL} AS level, type, count(*) AS n FROM state GROUP BY ALL")
def place_levels(spark, sf):
    return S.place(state_items(spark, sf)).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {STATE}, {CURRENT}, p AS (SELECT * FROM current_items WHERE CAST(session_id AS BIGINT) % 10 = 3 AND session_id <> '3' AND {LEVEL} = 'project' AND status = 'active'),
 r AS (SELECT *, row_number() OVER (PARTITION BY type, lower(content) ORDER BY session_id, created_at, id) AS k FROM p) SELECT id, session_id, type, content FROM r WHERE k = 1"""
)
def carry_forward(spark, sf):
    items = state_items(spark, sf).withColumn("project", (F.col("session_id").cast("bigint") % 10).cast("string"))
    return S.carried_forward(items, "3", "3").select("id", "session_id", "type", "content")


@query(f"WITH {STATE} SELECT CAST(CAST(session_id AS BIGINT) % 10 AS VARCHAR) AS project, count(DISTINCT session_id) AS sessions, count(*) AS items FROM state GROUP BY 1")
def group_by_project(spark, sf):
    return state_items(spark, sf).groupBy((F.col("session_id").cast("bigint") % 10).cast("string").alias("project")).agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("items"))


@query(f"WITH {STATE}, x AS (SELECT id, CASE WHEN id LIKE '%5' THEN 'gone-' || id ELSE supersedes END AS supersedes FROM state) SELECT id, supersedes FROM x WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM state s WHERE s.id = x.supersedes)")
def dangling_references(spark, sf):
    items = state_items(spark, sf)
    return S.dangling(items.withColumn("supersedes", F.when(F.col("id").like("%5"), F.concat(F.lit("gone-"), "id")).otherwise(F.col("supersedes")))).select("id", "supersedes")


@query(f"WITH {STATE}, x AS (SELECT id, session_id, CASE WHEN id LIKE '%9' THEN '0' ELSE supersedes END AS supersedes FROM state) SELECT x.id, x.session_id, s.session_id AS other_session FROM x JOIN state s ON s.id = x.supersedes WHERE s.session_id <> x.session_id")
def cross_session_references(spark, sf):
    items = state_items(spark, sf)
    return S.cross_session(items.withColumn("supersedes", F.when(F.col("id").like("%9"), F.lit("0")).otherwise(F.col("supersedes")))).select("id", "session_id", "other_session")


@query(f"WITH {STATE}, {ARCHIVE}, m AS (SELECT id, max(seq) AS seq FROM archive GROUP BY id) SELECT s.id, m.seq FROM state s LEFT JOIN m ON m.id = s.session_id || '-1'")
def evidence_resolution(spark, sf):
    items = state_items(spark, sf).select("id", F.concat("session_id", F.lit("-1")).alias("source"))
    return P.evidence_links(items, archive(spark, sf)).select("id", "seq")


@query(
    f"""WITH {ARCHIVE} SELECT session_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records, coalesce(string_agg(seq || '=' || hash, ',' ORDER BY seq) FILTER (kind = 'user_message'), '') AS hashes FROM archive GROUP BY session_id"""
)
def archive_reference(spark, sf):
    log = archive(spark, sf)
    found = P.archive_reference(log, log.where("kind = 'user_message'"))
    hashes = F.array_join(F.transform(F.array_sort(F.map_entries("record_hashes")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",")
    return found.select("session_id", "first_seq", "last_seq", "records", hashes.alias("hashes"))


@query("SELECT id, code, CAST(shape AS INT) AS shape FROM (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, 'instruction_like' AS code, 4 AS shape FROM conversations WHERE role = 'system' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'oversized_item', NULL FROM documents WHERE length(text) > 20000)")
def security_review(spark, sf):
    turns = archive(spark, sf).select("id", F.when(F.col("kind") == "system_message", F.concat(F.lit("<system> "), "payload")).otherwise(F.col("payload")).alias("content"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return P.review(turns).unionByName(P.review(docs))


@query(
    f"""WITH {STATE}, a AS (SELECT *, CASE type WHEN 'goal' THEN 1 WHEN 'constraint' THEN 2 WHEN 'fact' THEN 3 WHEN 'decision' THEN 4 ELSE 5 END AS rk, row_number() OVER (PARTITION BY session_id, type ORDER BY created_at, id) AS k FROM state WHERE status = 'active'),
 c AS (SELECT *, {STATE_COST} AS cost FROM a), r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY rk, created_at, id ROWS UNBOUNDED PRECEDING) AS spent FROM c)
 SELECT session_id, id, type, CAST(cost AS BIGINT) AS cost, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 60"""
)
def state_prefix_fit(spark, sf):
    return K.state_section(state_items(spark, sf), 60)


@query(rf"WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, md5(CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:49], ' ') || ' […cut]' END) AS cut FROM x")
def truncate_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.first_words(F.col("text"), 50, "[…cut]")).alias("cut"))


@query(f"WITH {ARCHIVE} SELECT session_id, seq, contains(lower(payload), 'the') AND contains(lower(payload), 'an') AND NOT contains(lower(payload), 'qu') AS passed FROM archive")
def retention_checks(spark, sf):
    low = F.lower("payload")
    every, none = F.array(F.lit("the"), F.lit("an")), F.array(F.lit("qu"))
    return archive(spark, sf).select("session_id", "seq", (F.forall(every, lambda x: F.contains(low, x)) & ~F.exists(none, lambda x: F.contains(low, x))).alias("passed"))


_SUMMARY = """count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded, round(count(*) FILTER (WHERE status = 'success' AND passed) / CAST(nullif(count(*) FILTER (WHERE status = 'success'), 0) AS DOUBLE), 9) AS retention,
 round(count(*) FILTER (WHERE status = 'success' AND completion = 'passed') / CAST(nullif(count(*) FILTER (WHERE status = 'success'), 0) AS DOUBLE), 9) AS completion_rate, count(*) FILTER (WHERE status = 'success' AND completion = 'fabricated') AS fabrications, round(avg(context_tokens) FILTER (WHERE status = 'success'), 6) AS mean_context_tokens"""


@query(f"WITH {RESULTS} SELECT strategy, budget, {_SUMMARY} FROM results GROUP BY strategy, budget")
def benchmark_cells(spark, sf):
    return E.summary(results(spark, sf), "strategy", "budget")


@query(f"WITH {RESULTS} SELECT strategy, {_SUMMARY} FROM results GROUP BY strategy")
def strategy_summary(spark, sf):
    return E.summary(results(spark, sf), "strategy")


@query(
    f"""WITH {RESULTS}, c AS (SELECT strategy, CASE WHEN status <> 'success' THEN 'not_measured' WHEN completion = 'fabricated' THEN 'hallucination' WHEN context_tokens > budget THEN 'budget_overflow' WHEN NOT passed THEN category || '_loss' END AS failure_class FROM results)
 SELECT strategy, failure_class, count(*) AS n FROM c WHERE failure_class IS NOT NULL GROUP BY ALL"""
)
def failure_taxonomy(spark, sf):
    return E.failure_class(results(spark, sf)).groupBy("strategy", "failure_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESULTS} SELECT strategy, count(DISTINCT model) AS models, count(DISTINCT model) <= 1 AS comparable FROM results GROUP BY strategy")
def comparability(spark, sf):
    return E.comparability(results(spark, sf))


@query(f"WITH {RESULTS} SELECT model FROM results GROUP BY model HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM results)")
def coverage_intersection(spark, sf):
    return E.shared_coverage(results(spark, sf), "model")


@query(f"WITH {RESULTS} SELECT CAST(doc_id AS VARCHAR) AS scenario_id, lang AS strategy FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT scenario_id FROM results)")
def resume_skip(spark, sf):
    planned = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("scenario_id"), F.col("lang").alias("strategy"))
    return E.pending_cells(planned, results(spark, sf), ["scenario_id", "strategy"])


@query(f"WITH {ARCHIVE}, n AS (SELECT session_id, max(seq) + 1 AS c FROM archive GROUP BY 1), m AS (SELECT session_id, max(seq) + 1 AS k FROM archive WHERE kind = 'user_message' GROUP BY 1) SELECT n.session_id, greatest(0, c - coalesce(k, 0)) AS pending FROM n LEFT JOIN m USING (session_id)")
def incremental_pending(spark, sf):
    log = archive(spark, sf)
    marks = I.advance(log.limit(0).select("session_id", F.col("seq").alias("next_seq")), log.where("kind = 'user_message'"))
    return I.pending(log, marks)


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return I.windowed(table(spark, sf, "events")).select(F.unix_timestamp(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n", "total")


@query(f"WITH RECURSIVE {THREAD}, up AS (SELECT id, parent_id AS cur FROM thread UNION ALL SELECT u.id, t.parent_id FROM up u JOIN thread t ON t.id = u.cur WHERE t.kind <> 'user_message') SELECT t.id, u.cur AS ancestor FROM thread t LEFT JOIN (SELECT up.id, up.cur FROM up JOIN thread x ON x.id = up.cur AND x.kind = 'user_message') u ON u.id = t.id")
def nearest_ancestor(spark, sf):
    return H.nearest(thread(spark, sf), "kind = 'user_message'")


_ITEMS = "items AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 120 AS VARCHAR) AS session_id, text AS content, n_chars % 9 AS cited FROM documents)"
_OVER = r"list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9._-]*'), lambda w: length(w) > 2 AND NOT list_contains([{}], w)))".format(", ".join(f"'{w}'" for w in T.UNGROUNDED))


@query(
    f"""WITH {ARCHIVE}, {_ITEMS}, j AS (SELECT i.*, (SELECT max(seq) FROM archive a WHERE a.session_id = i.session_id) AS lst, a.payload FROM items i LEFT JOIN archive a ON a.session_id = i.session_id AND a.seq = i.cited), o AS (SELECT *, {_OVER} AS own FROM j),
 c AS (SELECT id, CASE WHEN lst IS NULL OR cited > lst THEN 'out_of_range' WHEN len(own) > 0 AND len(list_filter(own, lambda w: contains(lower(payload), w))) / CAST(len(own) AS DOUBLE) < 0.34 THEN 'weak_grounding' END AS code FROM o)
 SELECT id, CASE WHEN code = 'weak_grounding' THEN 'warning' ELSE 'error' END AS severity, code FROM c WHERE code IS NOT NULL"""
)
def extraction_findings(spark, sf):
    d = table(spark, sf, "documents")
    items = d.select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 120).cast("string").alias("session_id"), F.col("text").alias("content"), (F.col("n_chars") % 9).alias("cited"))
    return X.findings(items, archive(spark, sf))


_NUMBERED = """numbered AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, event_type, json_extract_string(props, '$.k') AS k FROM events),
 stated AS (SELECT session_id, seq, 0 AS pos, k AS value, event_type || ' limit (seconds)' AS label FROM numbered UNION ALL SELECT session_id, seq, 1, CAST(seq AS VARCHAR), 'seconds on port' FROM numbered),
 firsts AS (SELECT session_id, value, min((seq, pos, label)) AS f FROM stated WHERE value NOT IN ('0', '1', '2') GROUP BY ALL), ledger AS (SELECT session_id, value, f[1] AS seq, f[3] AS label, row_number() OVER (PARTITION BY session_id ORDER BY f) AS n FROM firsts QUALIFY n <= 24)"""


def _numbered(spark, sf):
    said = F.concat(F.lit("The "), "event_type", F.lit(" limit is "), F.get_json_object("props", "$.k"), F.lit(" seconds on port "), "event_id", F.lit(" now."))
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "event_type", said.alias("payload"))


@query(f"WITH {_NUMBERED} SELECT session_id, value, label, seq, CAST(n AS INT) AS n FROM ledger")
def literal_ledger(spark, sf):
    return X.literals(_numbered(spark, sf))


@query(f"WITH {_NUMBERED} SELECT session_id, value FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM numbered f WHERE f.session_id = l.session_id AND f.event_type IN ('click', 'error') AND (f.k = l.value OR CAST(f.seq AS VARCHAR) = l.value))")
def missing_literals(spark, sf):
    log = _numbered(spark, sf)
    return X.missing_literals(X.literals(log), log.where("event_type in ('click', 'error')")).select("session_id", "value")


@query(f"WITH {ARCHIVE}, c AS (SELECT session_id, CAST(len(payload) AS BIGINT) AS n, kind <> 'system_message' AS exact, CASE WHEN seq < 4 THEN 'words' ELSE 'chars' END AS method FROM archive) SELECT session_id, CAST(sum(n) AS BIGINT) AS count, bool_and(exact) AS exact, CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'mixed' END AS method FROM c GROUP BY session_id")
def token_totals(spark, sf):
    rows = archive(spark, sf).select("session_id", F.length("payload").cast("bigint").alias("count"), (F.col("kind") != "system_message").alias("exact"), F.when(F.col("seq") < 4, "words").otherwise("chars").alias("method"))
    return X.token_total(rows, "session_id")


@query(f"WITH {RESULTS} SELECT category, count(*) AS checks, round(avg(CAST(passed AS INT)), 9) AS score FROM results WHERE status = 'success' GROUP BY category")
def category_scores(spark, sf):
    return E.category_scores(results(spark, sf))


@query(f"WITH {RESULTS} SELECT model, CASE WHEN bool_or(completion = 'not_evaluable') THEN NULL ELSE bool_and(completion = 'passed') END AS completed FROM results GROUP BY model")
def completion_status(spark, sf):
    return E.completed(results(spark, sf), "model")


@query(f"WITH {RESULTS} SELECT count(*) AS judged, round(count(*) FILTER (WHERE passed) / CAST(nullif(count(*), 0) AS DOUBLE), 9) AS share, count(*) FILTER (WHERE passed) / CAST(nullif(count(*), 0) AS DOUBLE) < 0.7 AS void FROM results WHERE strategy = 'en' AND status = 'success'")
def judge_calibration(spark, sf):
    return E.calibration(results(spark, sf), "en")


_PACKAGED = """packages AS (SELECT CAST(conv_id AS VARCHAR) AS package_id, conv_id AS n, CAST(conv_id AS VARCHAR) AS session_id FROM conversations GROUP BY conv_id),
 held AS (SELECT CAST(user_id AS VARCHAR) AS package_id, CAST(event_id AS VARCHAR) AS id, CAST(CASE WHEN event_id % 50 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR) AS session_id, event_id AS n FROM events JOIN packages ON packages.n = user_id),
 proof AS (SELECT package_id, CASE WHEN n % 17 = 0 THEN 'none-' || id ELSE id END AS item_id, CASE WHEN n % 4 = 0 THEN [] ELSE [n % 9] END AS seqs FROM held WHERE n % 3 <> 0)"""


def _packaged(spark, sf):
    log = archive(spark, sf)
    n = F.col("session_id").cast("bigint")
    hashes = log.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("kind") == "user_message", F.struct("seq", F.when(n % 3 == 0, "bad").otherwise(F.col("hash")).alias("h"))))).alias("record_hashes"))
    packages = hashes.select(
        F.col("session_id").alias("package_id"),
        "session_id",
        F.when(n % 7 == 0, 2).otherwise(1).alias("format_version"),
        F.when(n % 11 == 0, 2).otherwise(1).alias("state_version"),
        F.when(n % 5 != 0, "same").alias("content_hash"),
        F.lit("same").alias("expected_hash"),
        F.when(n % 9 == 0, F.concat("session_id", F.lit("-other"))).otherwise(F.col("session_id")).alias("archive_session_id"),
        F.when(n % 13 != 0, F.col("record_hashes")).alias("record_hashes"),
    )
    e = F.col("event_id")
    events = table(spark, sf, "events").withColumn("package_id", F.col("user_id").cast("string")).join(packages.select("package_id"), "package_id")
    state = state_items(spark, sf).select("id", "status", "supersedes")
    items = events.select("package_id", e.cast("string").alias("id"), F.when(e % 50 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string").alias("session_id")).join(state, "id")
    proof = events.where(e % 3 != 0).select("package_id", F.when(e % 17 == 0, F.concat(F.lit("none-"), e)).otherwise(e.cast("string")).alias("item_id"), F.when(e % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(e % 9)).alias("seqs"))
    return packages, items, proof, log


@query(
    f"""WITH {STATE}, {ARCHIVE}, {_PACKAGED}, named AS (SELECT * FROM packages WHERE n % 13 <> 0), cited AS (SELECT p.package_id, CASE WHEN p.n % 9 = 0 THEN session_id || '-other' ELSE session_id END AS s, a.seq, CASE WHEN p.n % 3 = 0 THEN 'bad' ELSE a.hash END AS h FROM named p JOIN archive a USING (session_id) WHERE a.kind = 'user_message'),
 shown AS (SELECT DISTINCT package_id, unnest(seqs) AS seq FROM proof)
 SELECT 'error' AS severity, 'unreadable_version' AS code, package_id, NULL AS id FROM packages WHERE n % 7 = 0 UNION ALL SELECT 'error', 'unreadable_state_schema', package_id, NULL FROM packages WHERE n % 11 = 0 UNION ALL SELECT 'error', 'hash_mismatch', package_id, NULL FROM packages WHERE n % 5 = 0
 UNION ALL SELECT 'error', 'foreign_state', package_id, id FROM held WHERE n % 50 = 0 UNION ALL SELECT 'error', 'superseded_included', package_id, held.id FROM held JOIN state USING (id) WHERE status = 'superseded'
 UNION ALL SELECT 'error', 'orphan_evidence', package_id, item_id FROM proof WHERE item_id LIKE 'none-%' UNION ALL SELECT 'warning', 'state_without_evidence', package_id, id FROM held WHERE n % 3 = 0 OR n % 17 = 0 UNION ALL SELECT 'warning', 'unresolvable_provenance', package_id, item_id FROM proof WHERE len(seqs) = 0
 UNION ALL SELECT 'warning', 'supersedes_absent', h.package_id, h.id FROM held h JOIN state s USING (id) WHERE s.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held o WHERE o.package_id = h.package_id AND o.id = s.supersedes) UNION ALL SELECT 'warning', 'no_archive_reference', package_id, NULL FROM packages WHERE n % 13 = 0
 UNION ALL SELECT 'error', 'archive_session_mismatch', package_id, NULL FROM named WHERE n % 9 = 0 UNION ALL SELECT 'error', 'cited_record_missing', package_id, CAST(seq AS VARCHAR) FROM cited c WHERE s LIKE '%-other' UNION ALL SELECT 'error', 'cited_record_changed', package_id, CAST(seq AS VARCHAR) FROM cited WHERE s NOT LIKE '%-other' AND h = 'bad'
 UNION ALL SELECT 'warning', 'evidence_outside_archive', package_id, CAST(seq AS VARCHAR) FROM shown WHERE NOT EXISTS (SELECT 1 FROM archive a WHERE a.session_id = shown.package_id AND a.seq = shown.seq)"""
)
def package_validate(spark, sf):
    packages, items, proof, log = _packaged(spark, sf)
    return P.validate(packages, items, proof, log)


@query(f"WITH {_PACKAGED} SELECT id, 'unverified_content' AS code FROM held WHERE n % 3 = 0 OR n % 17 = 0 OR n % 4 = 0")
def untraced_items(spark, sf):
    _, items, proof, _ = _packaged(spark, sf)
    return P.untraced(items, proof).select("id", "code")


@query(f"WITH {STATE} SELECT id, session_id, type FROM state WHERE type IN ('goal', 'decision') AND status = 'active'")
def state_listing(spark, sf):
    return S.listing(state_items(spark, sf), ["goal", "decision"], "active").select("id", "session_id", "type")


def _snapshots(spark, sf):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), before.alias("parent_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def snapshot_lineage(spark, sf):
    return S.lineage(_snapshots(spark, sf))


@query("SELECT o_custkey AS session_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, CAST(max(epoch_us(o_orderdate)) AS BIGINT) AS created_us FROM orders GROUP BY o_custkey")
def latest_snapshot(spark, sf):
    return S.latest(_snapshots(spark, sf)).select("session_id", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


_MESSAGES = "m AS (SELECT id, session_id, CASE WHEN seq = 6 THEN 5 ELSE seq - 1 END AS seq, CASE WHEN seq = 2 THEN 'tool' ELSE 'user' END AS role, CASE WHEN seq = 4 THEN 'ls' END AS tool_name, CASE WHEN seq = 3 THEN id END AS parent_id FROM archive)"


@query(
    f"""WITH {ARCHIVE}, {_MESSAGES} SELECT id, 'negative_seq' AS code FROM m WHERE seq < 0 UNION ALL SELECT id, 'own_parent' FROM m WHERE parent_id = id UNION ALL SELECT id, 'tool_without_name' FROM m WHERE role = 'tool' AND tool_name IS NULL
 UNION ALL SELECT id, 'name_without_tool' FROM m WHERE role <> 'tool' AND tool_name IS NOT NULL UNION ALL SELECT min(id), 'repeated_seq' FROM m GROUP BY session_id, seq HAVING count(*) > 1"""
)
def message_integrity(spark, sf):
    seq = F.col("seq")
    m = archive(spark, sf).select("id", "session_id", F.when(seq == 6, 5).otherwise(seq - 1).alias("seq"), F.when(seq == 2, "tool").otherwise("user").alias("role"), F.when(seq == 4, "ls").alias("tool_name"), F.when(seq == 3, F.col("id")).alias("parent_id"))
    return S.integrity(m)


@query("SELECT CAST(item_id AS VARCHAR) AS scenario_id, CAST(r AS INT) AS repetition, strategy, CAST(budget AS INT) AS budget FROM benchmark, range(1, 4) AS t(r), (VALUES ('full', NULL), ('summary', 160), ('summary', 900), ('hybrid', 160), ('hybrid', 900)) AS c(strategy, budget)")
def matrix_expansion(spark, sf):
    scenarios = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("scenario_id"))
    return E.matrix(scenarios, ["full", "summary", "hybrid"], [160, 900], "full", 3)


@query(
    f"""WITH {ARCHIVE}, c AS (SELECT session_id, seq, {WORDS.format('payload')} + 3 AS cost FROM archive), r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY seq DESC) <= 160 AS stays FROM c),
 s AS (SELECT session_id, sum(cost) AS total, coalesce(min(seq) FILTER (stays), max(seq) + 1) AS start, coalesce(sum(cost) FILTER (stays), 0) AS kept FROM r GROUP BY session_id)
 SELECT session_id, CAST(total AS BIGINT) AS input_tokens, total <= 400 AS fits, CAST(CASE WHEN total <= 400 THEN 0 ELSE start END AS BIGINT) AS split, CAST(CASE WHEN total <= 400 THEN total ELSE kept END AS BIGINT) AS recent_tokens, CAST(CASE WHEN total <= 400 THEN 0 ELSE 240 END AS BIGINT) AS summary_tokens FROM s"""
)
def compaction_plan(spark, sf):
    return plan_compaction(archive(spark, sf), 400)


@query()
def render_packages(spark, sf):
    """No SQL: JSON text of nested structures; tests read it back."""
    log = archive(spark, sf)
    sections = log.select(F.col("session_id").alias("package_id"), F.col("seq").alias("rank"), F.when(F.col("seq") == 0, "task").otherwise("recent").alias("section"), F.col("payload").alias("text"))
    return P.render(sections, "anthropic")


@query(
    f"""WITH {STATE}, {ARCHIVE}, a AS (SELECT *, CASE type WHEN 'goal' THEN 1 WHEN 'constraint' THEN 2 WHEN 'fact' THEN 3 WHEN 'decision' THEN 4 ELSE 5 END AS rk, row_number() OVER (PARTITION BY session_id, type ORDER BY created_at, id) AS k FROM state WHERE status = 'active'),
 c AS (SELECT *, {STATE_COST} AS cost FROM a), r AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY rk, created_at, id ROWS UNBOUNDED PRECEDING) AS spent FROM c), st AS (SELECT * FROM r WHERE spent <= 72), used AS (SELECT session_id, sum(cost) AS used FROM st GROUP BY 1),
 t AS (SELECT session_id, id, {WORDS.format('payload')} + 1 + CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1 THEN 2 ELSE 0 END AS cost, seq FROM archive WHERE {WORDS.format('payload')} > 0), u AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY seq DESC) AS spent FROM t)
 SELECT 'state' AS section, session_id, id, CAST(cost AS BIGINT) AS cost FROM st UNION ALL SELECT 'recent', session_id, u.id, CAST(cost AS BIGINT) FROM u LEFT JOIN used USING (session_id) WHERE spent <= 115 - coalesce(used, 0)"""
)
def compile_sections(spark, sf):
    return K.compile_context(state_items(spark, sf), archive(spark, sf), "go on with the work", 120)


@query(f"WITH {ARCHIVE} SELECT session_id, seq, md5('[' || kind || CASE WHEN seq = 2 THEN ' name=ls' ELSE '' END || '] ' || payload) AS line, CASE kind WHEN 'assistant_message' THEN 'assistant' WHEN 'system_message' THEN 'system' ELSE 'user' END AS role FROM archive")
def rendered_events(spark, sf):
    line = R.rendered(F.col("kind"), F.when(F.col("seq") == 2, "ls"), F.lit(None).cast("string"), F.col("payload"), F.lit("{}"))
    return archive(spark, sf).select("session_id", "seq", F.md5(line).alias("line"), R.role_of(F.col("kind")).alias("role"))


@query(
    f"""WITH {STATE}, a AS (SELECT session_id, type, CASE type WHEN 'goal' THEN 1 WHEN 'constraint' THEN 2 WHEN 'fact' THEN 3 WHEN 'decision' THEN 4 ELSE 5 END AS rk, string_agg('- ' || content || coalesce(' (because: ' || rationale || ')', ''), chr(10) ORDER BY created_at, id) AS lines FROM state WHERE status = 'active' GROUP BY session_id, type)
 SELECT session_id, md5(string_agg(CASE rk WHEN 1 THEN 'GOALS' WHEN 2 THEN 'CONSTRAINTS' WHEN 3 THEN 'FACTS' WHEN 4 THEN 'DECISIONS' ELSE 'OPEN WORK' END || chr(10) || lines, chr(10) || chr(10) ORDER BY rk)) AS text FROM a GROUP BY session_id"""
)
def rendered_state(spark, sf):
    return R.render_state(state_items(spark, sf)).select("session_id", F.md5("text").alias("text"))


@query(f"WITH {_NUMBERED} SELECT session_id, md5('EXACT VALUES' || chr(10) || string_agg('- ' || label || ': ' || value, chr(10) ORDER BY n)) AS text FROM ledger GROUP BY session_id")
def rendered_ledger(spark, sf):
    return R.render_ledger(X.literals(_numbered(spark, sf))).select("session_id", F.md5("text").alias("text"))


@query("SELECT event_id, 'synth-' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 24) || '-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id, event_type IN ('click', 'view') AS valid FROM events")
def synthetic_ids(spark, sf):
    made = ID.synthetic_id(F.col("user_id").cast("string"), F.col("event_id"))
    minted = F.concat(F.when(F.col("event_type") == "click", "fact_").when(F.col("event_type") == "view", "msg_").when(F.col("event_type") == "error", "nope_").otherwise("fact-"), ID.short_hash(F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", made.alias("id"), ID.is_valid(minted).alias("valid"))


@query(f"WITH {ARCHIVE} SELECT session_id, seq, '{{\"hash\":\"' || hash || '\",\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"payload\":' || {JSON_TEXT.format('payload')} || ',\"seq\":' || seq || '}}' AS line FROM archive")
def record_lines(spark, sf):
    return W.record_lines(archive(spark, sf))


@query(
    f"""WITH {ARCHIVE}, ev AS (SELECT id, session_id, payload AS content, CASE WHEN seq = 4 THEN [] WHEN seq = 5 THEN ['a', 'a'] WHEN seq = 6 THEN [''] ELSE [id] END AS sources, seq FROM archive)
 SELECT id, 'no_sources' AS code FROM ev WHERE seq = 4 UNION ALL SELECT id, 'repeated_source' FROM ev WHERE seq = 5 UNION ALL SELECT id, 'blank_source' FROM ev WHERE seq = 6 UNION ALL SELECT id, 'hash_mismatch' FROM ev WHERE seq = 1 UNION ALL SELECT id, 'empty_content' FROM ev WHERE content = ''"""
)
def evidence_integrity(spark, sf):
    seq = F.col("seq")
    evidence = archive(spark, sf).select("id", F.col("payload").alias("content"), F.when(seq != 1, content_hash(F.col("payload"))).alias("content_hash"), F.when(seq == 4, F.array().cast("array<string>")).when(seq == 5, F.array(F.lit("a"), F.lit("a"))).when(seq == 6, F.array(F.lit(""))).otherwise(F.array("id")).alias("source_ids"))
    return G.evidence_violations(evidence)


@query(
    f"""WITH {STATE}, x AS (SELECT *, CAST(id AS BIGINT) AS n FROM state) SELECT id, 'critical_without_source' AS code FROM x WHERE retention = 'critical' AND n % 2 = 0 UNION ALL SELECT id, 'supersedes_itself' FROM x WHERE n % 19 = 0 UNION ALL SELECT id, 'relates_to_itself' FROM x WHERE n % 23 = 0
 UNION ALL SELECT id, 'decision_without_rationale' FROM x WHERE type = 'decision' AND rationale IS NULL UNION ALL SELECT id, 'blocked_without_blocker' FROM x WHERE type = 'task' AND n % 3 = 0"""
)
def state_integrity(spark, sf):
    n, none = F.col("id").cast("bigint"), F.array().cast("array<string>")
    items = state_items(spark, sf).withColumns({"sources": F.when(n % 2 == 0, none).otherwise(F.array(F.lit("s"))), "supersedes": F.when(n % 19 == 0, F.col("id")).otherwise(F.lit("other")), "related_ids": F.when(n % 23 == 0, F.array("id")).otherwise(none), "task_status": F.when((F.col("type") == "task") & (n % 3 == 0), "blocked"), "blocked_by": none})
    return G.state_violations(items)


@query("SELECT 'conversations' AS relation, count(*) AS n FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def table_counts(spark, sf):
    return G.table_counts(**{t: table(spark, sf, t) for t in ("conversations", "events", "labels")})


@query(
    f"""WITH {STATE}, u AS (SELECT session_id, type, lower(trim(content)) AS c, count(*) AS n FROM state WHERE status = 'active' GROUP BY ALL HAVING count(*) > 1), f AS (SELECT session_id, lower(trim(subject)) AS s, count(DISTINCT lower(trim(content))) AS k, count(*) AS n FROM state WHERE status = 'active' AND type = 'fact' AND trim(subject) <> '' GROUP BY ALL HAVING k > 1), g AS (SELECT supersedes, count(*) AS n FROM state WHERE supersedes IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
 SELECT 1 AS rank, 'duplicate_active' AS kind, session_id, type || ':' || c AS key, n FROM u UNION ALL SELECT 2, 'contradictory_facts', session_id, s, n FROM f UNION ALL SELECT 3, 'supersession_fork', NULL, supersedes, n FROM g"""
)
def all_conflicts(spark, sf):
    return S.all_conflicts(state_items(spark, sf))


def _imported(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), n.alias("position"), F.when(n % 31 == 0, "blank").when(n % 37 == 0, "invalid_json").alias("reason"), F.when(n % 41 == 0, "other").otherwise("user_message").alias("type"), F.when(n % 29 != 0, (n % 400).cast("string")).alias("source_id"), F.when(n % 5 != 0, "t").alias("time_text"), F.when(n % 7 != 0, F.col("ts")).alias("timestamp")
    )


@query(
    """WITH i AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS n, CASE WHEN event_id % 31 = 0 THEN 'blank' WHEN event_id % 37 = 0 THEN 'invalid_json' END AS reason, event_id % 41 = 0 AS other, CASE WHEN event_id % 29 <> 0 THEN event_id % 400 END AS sid, event_id % 5 <> 0 AS has_text, event_id % 7 <> 0 AS has_time FROM events),
 k AS (SELECT *, sid IS NOT NULL AND n > min(n) OVER (PARTITION BY session_id, sid) AS again FROM i),
 r AS (SELECT session_id, count(*) FILTER (reason IS NULL) AS events, count(*) FILTER (reason IS NULL AND sid IS NULL) AS missing_ids, count(*) FILTER (reason IS NULL AND NOT has_time) AS missing_times, count(*) FILTER (reason IS NULL AND NOT has_time AND has_text) AS unusable_times, count(*) FILTER (reason IS NULL AND again) AS duplicates, count(*) FILTER (reason = 'blank') AS blank, count(*) FILTER (reason = 'invalid_json') AS malformed, count(*) FILTER (reason IS NULL AND other) AS unknown_types FROM k GROUP BY session_id)
 SELECT *, missing_ids + unusable_times + duplicates + malformed + unknown_types = 0 AS clean FROM r"""
)
def import_reports(spark, sf):
    return L.import_report(_imported(spark, sf))


@query("WITH f AS (SELECT user_id, event_id % 400 AS v, min(event_id) AS pos FROM events WHERE event_id % 29 <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS n FROM f QUALIFY n <= 20) SELECT CAST(user_id AS VARCHAR) AS session_id, string_agg(v, ',' ORDER BY n) AS ids FROM r GROUP BY user_id")
def import_samples(spark, sf):
    return L.samples(_imported(spark, sf), "source_id").select("session_id", F.array_join("values", ",").alias("ids"))


@query(f"WITH {ARCHIVE}, t AS (SELECT session_id, seq, payload FROM archive) SELECT session_id, seq, CASE WHEN seq = 7 THEN 'not_evaluable' WHEN contains(lower(payload), 'qu') THEN 'fabricated' WHEN NOT (contains(lower(payload), 'the') OR contains(lower(payload), 'la')) THEN 'omitted' WHEN {WORDS.format('payload')} < 20 THEN 'insubstantial' ELSE 'passed' END AS outcome FROM t")
def completion_outcomes(spark, sf):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    return archive(spark, sf).select("session_id", "seq", E.outcome(F.col("payload"), words("THE", "la"), words("Qu"), F.lit(20), F.col("seq") == 7).alias("outcome"))


@query(
    f"""WITH {RESULTS}, w AS (SELECT *, CAST(scenario_id AS BIGINT) % 6 = 0 AS bad FROM results), m AS (SELECT *, status = 'success' AND NOT bad AS own FROM w)
 SELECT strategy, budget, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'success' AND bad) AS disowned, round(count(*) FILTER (own AND passed) / CAST(nullif(count(*) FILTER (own), 0) AS DOUBLE), 9) AS retention, round(avg(context_tokens) FILTER (own), 6) AS mean_context_tokens, CASE WHEN count(*) FILTER (status <> 'success') > 0 THEN 'model_error=' || count(*) FILTER (status <> 'success') END AS failures FROM m GROUP BY strategy, budget"""
)
def disowned_cells(spark, sf):
    rows = results(spark, sf).withColumn("warnings", F.when(F.col("scenario_id").cast("bigint") % 6 == 0, F.array(F.lit("this should not be read as a result"))))
    text = F.array_join(F.transform(F.map_entries("failures"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return E.cells(rows).withColumn("failures", text)


@query(f"WITH {RESULTS}, s AS (SELECT model, strategy, count(*) AS runs, count(*) FILTER (passed) AS passed FROM results GROUP BY ALL) SELECT model, strategy, runs, passed FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE (o.runs <= s.runs AND o.passed > s.passed) OR (o.runs < s.runs AND o.passed >= s.passed))")
def pareto_points(spark, sf):
    sums = results(spark, sf).groupBy("model", "strategy").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"))
    return E.pareto(sums, "runs", "passed")


@query(
    f"""WITH {RESULTS}, ok AS (SELECT DISTINCT CASE WHEN strategy = 'en' THEN 0 ELSE budget END AS budget, strategy, model AS scenario_id FROM results WHERE status = 'success'), arms AS (SELECT * FROM ok WHERE budget <> 0 UNION ALL SELECT b.budget, r.strategy, r.scenario_id FROM ok r, (SELECT DISTINCT budget FROM ok WHERE budget <> 0) b WHERE r.budget = 0),
 n AS (SELECT budget, count(DISTINCT strategy) AS arms FROM arms GROUP BY 1), c AS (SELECT budget, scenario_id, count(DISTINCT strategy) AS k FROM arms GROUP BY ALL), sh AS (SELECT c.budget, count(*) AS shared FROM c JOIN n USING (budget) WHERE k = arms GROUP BY 1), z AS (SELECT budget, strategy, count(DISTINCT scenario_id) AS scenarios FROM arms GROUP BY ALL)
 SELECT z.budget, strategy, scenarios, coalesce(shared, 0) AS shared FROM z JOIN n USING (budget) LEFT JOIN sh USING (budget) WHERE arms > 1 AND scenarios <> coalesce(shared, 0)"""
)
def coverage_gaps(spark, sf):
    rows = results(spark, sf).select(F.when(F.col("strategy") == "en", 0).otherwise(F.col("budget")).alias("budget"), "strategy", F.col("model").alias("scenario_id"), "status")
    return E.coverage_problems(rows)


@query(f"WITH {RESULTS} SELECT 'mixed_' || code AS code, found FROM (SELECT 'model' AS code, count(DISTINCT model) AS found FROM results UNION ALL SELECT 'prompt', count(DISTINCT category) FROM results UNION ALL SELECT 'dataset_version', 1 UNION ALL SELECT 'evaluation_mode', count(DISTINCT status) FROM results) WHERE found > 1")
def comparison_problems(spark, sf):
    return E.problems(results(spark, sf).select("model", F.col("category").alias("prompt"), F.lit("v").alias("dataset_version"), F.col("status").alias("evaluation_mode")))


@query(
    f"""WITH {RESULTS}, r AS (SELECT *, CAST(scenario_id AS BIGINT) % 3 AS m FROM results WHERE status = 'success') SELECT strategy, CASE WHEN category = 'constraint' THEN CASE m WHEN 0 THEN 'lost_negative_constraint' ELSE 'lost_constraint' END ELSE 'unclassified' END AS failure_class, count(*) AS n FROM r WHERE NOT passed GROUP BY ALL
 UNION ALL SELECT strategy, 'hallucination', count(*) FROM r WHERE completion = 'fabricated' GROUP BY ALL UNION ALL SELECT strategy, 'budget_overflow', count(*) FROM r WHERE context_tokens > budget GROUP BY ALL"""
)
def failure_observations(spark, sf):
    m = F.col("scenario_id").cast("bigint") % 3
    rows = results(spark, sf).select(
        "strategy", "scenario_id", "status", "context_tokens", F.col("budget").alias("target_tokens"), F.when(m == 0, F.array(F.lit("negative_constraint"), F.lit("current_state"))).otherwise(F.array(F.lit("exact_value"))).alias("failure_modes"),
        F.array(F.struct("category", "passed")).alias("retention_checks"), F.array(F.struct(F.col("completion").alias("status"))).alias("completion"),
    )
    return E.observations(rows).groupBy("strategy", "failure_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ARCHIVE}, h AS (SELECT session_id, seq, {WORDS.format('payload')} AS n FROM archive), w AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY seq DESC) AS spent FROM h) SELECT session_id, seq FROM w WHERE spent <= 90")
def dropped_recent(spark, sf):
    return C.drop_recent(archive(spark, sf).select("session_id", "seq", T.word_count(F.col("payload")).alias("cost")), 90).select("session_id", "seq")


@query(
    r"""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || role || '</think>' || chr(10) || '```json' || chr(10) || '{"a": ' || turn || '}' || chr(10) || '```' WHEN 1 THEN 'So: {"a": "x"} done' WHEN 2 THEN '{"b": 1}' ELSE 'no { object' END AS text FROM conversations)
 SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'type:a' WHEN 2 THEN 'missing:a' WHEN 3 THEN 'not_an_object' END AS reason FROM r"""
)
def structured_replies(spark, sf):
    t = F.col("turn") % 4
    text = F.when(t == 0, F.concat(F.lit("<think>"), "role", F.lit("</think>\n```json\n{\"a\": "), "turn", F.lit("}\n```"))).when(t == 1, 'So: {"a": "x"} done').when(t == 2, '{"b": 1}').otherwise("no { object")
    return table(spark, sf, "conversations").select("conv_id", "turn", PA.structured(text, {"a": "BIGINT"}).alias("reason"))


@query(
    f"""WITH {STATE}, {ARCHIVE}, a AS (SELECT * FROM state WHERE status <> 'superseded'), m AS (SELECT session_id, id, max(seq) AS seq FROM archive GROUP BY ALL), e AS (SELECT a.session_id, a.id, m.seq FROM a LEFT JOIN m ON m.session_id = a.session_id AND m.id = a.session_id || '-' || (CAST(a.id AS BIGINT) % 12))
 SELECT session_id, count(*) AS items, count(seq) AS resolved, count(DISTINCT seq) AS cited, coalesce((SELECT count(*) FROM archive x WHERE x.session_id = e.session_id), 0) AS records, least(3, (SELECT count(*) FROM archive x WHERE x.session_id = e.session_id AND {WORDS.format('payload')} > 0)) AS recent FROM e GROUP BY session_id"""
)
def built_packages(spark, sf):
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    items = state_items(spark, sf).withColumn("sources", F.array(F.concat_ws("-", "session_id", F.col("id").cast("bigint") % 12)))
    built = K.build(items, archive(spark, sf), recent=3)
    return built.select("session_id", n("state").alias("items"), F.size(F.filter("evidence", lambda e: F.size(e["seqs"]) > 0)).cast("bigint").alias("resolved"), n(F.map_keys("archive.record_hashes")).alias("cited"), F.coalesce("archive.records", F.lit(0)).alias("records"), n("recent").alias("recent"))
