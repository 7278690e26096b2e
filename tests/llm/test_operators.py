"""Operators against brute force, exact round trips, held-out figures and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import components, decontaminate, language_id, license_scan, line_dedup, lm_mixing, packing, quality_qda, quality_rules, sharding, simhash
from quillstone.llm.base import documents, fold
from quillstone.llm.doc_stats import add_stats

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [None, "", " \n\t ", "a", "É è", "a b", "x " * 3000, "same line here\nsame line here\n\nsame line here", "w" * 3000, "a b c a b c a b c", "Ünder the MIT License under the mit license"]
VOCABULARY = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "io", "un")]


def words_text(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def real(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_stats(text):
    w = re.findall(WORD, text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_stats_equal_brute_force(spark, docs_of):
    rnd = random.Random(1)
    texts = EDGES + ["".join(rnd.choice("ab \n\x0b é#|") for _ in range(rnd.randrange(200))) for _ in range(150)]
    got = {r["doc_id"]: r for r in add_stats(documents(docs_of(texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_stats(t), repr(t)


def test_rules_are_learned(spark):
    rows = [(i, 100, 500, 200 if i % 5 == 0 else 2, 0, 0, 10, 5, 5, 0, 90) for i in range(600)]
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_marks n_digits n_unique".split()
    stats = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(600)], "doc_id bigint, quality int")
    made = quality_rules.learn(stats, labels)
    assert len(made.rules) == 1 and "symbol_ratio >" in str(made)
    assert quality_rules.apply_rules(stats, made).where("kept <> (doc_id % 5 <> 0)").count() == 0
    assert quality_rules.learn(stats, labels.limit(0)).rules == []


def test_quality_queries_on_real_tables(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rules = {r["doc_id"]: r for r in quality_rules.op1_quality_rules(spark, SF).collect()}
    assert len(rules) == 1000
    assert sum(r["kept"] == (labels[i] == 1) for i, r in rules.items() if i in labels and not r["base_failed"]) / sum(not rules[i]["base_failed"] for i in labels) > 0.9
    got = [r for r in quality_qda.op5_quality_classifier(spark, SF).collect()]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9


def test_language_id(spark, docs_of):
    got = [r for r in language_id.op2_language_id(spark, SF).collect()]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    rows = docs_of([*EDGES, "12 34", ("the cat", None)])
    model = language_id.learn(rows.select("text", "lang"))
    out = {r["doc_id"]: r for r in language_id.predict(documents(rows), model).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[len(EDGES)]["lang_pred"] == "und" and out[3]["lang_pred"] == "en"
    assert [language_id.has_letter(t) for t in (None, "", "12 ² ½ _", "²é", "12 a")] == [False, False, False, True, True]
    none = language_id.learn(rows.where("false").select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(documents(rows), none).collect()} == {"und"}


def test_long_text_in_pieces_scores_like_one(monkeypatch):
    model = language_id.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=((1 << 15) + 1, 2)).astype(np.float32), np.zeros(2), (2, 3), 15)
    model.logs[-1] = 0
    text = words_text(random.Random(2), 4000)
    whole = model.log_densities([text, "bada"])
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert np.allclose(whole, model.log_densities([text, "bada"]), rtol=1e-6)


def test_license_base_equals_brute_force(spark, docs_of):
    rnd = random.Random(3)
    bag = "under the mit license apache version 2 cc by nc Under, MIT. CC BY-NC 4.0 é K".split()
    texts = EDGES + [" ".join(rnd.choice(bag) for _ in range(rnd.randrange(60))) for _ in range(60)] + ["apache license version 2 0 " * 40]
    phrases = {t.label: t.text.split() for t in license_scan.PHRASES}
    found = license_scan.scan(documents(docs_of(texts)), license_scan.PHRASES + license_scan.NOTICES).where("exact and found")
    got = defaultdict(set)
    for r in found.collect():
        got[r["doc_id"]].add((r["label"], r["start"]))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        assert got[i] == {(k, j) for k, p in phrases.items() for j in range(len(w)) if w[j : j + len(p)] == p}, t


def test_license_query_and_notices(spark, tmp_path, docs_of):
    notice = license_scan.NOTICES[2].text
    docs_of([*EDGES, f"x y {notice} z", notice.replace("general", "extra general"), notice, notice], ids=[*range(len(EDGES)), 90, 91, 92, 92]).write.parquet(str(tmp_path / "documents.parquet"))
    got = license_scan.op3_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(EDGES) + 4
    assert {r["labels"] for r in got if r["doc_id"] >= 90} == {"gpl-3"} and all(0 <= r["score"] <= 1 for r in got)
    last = next(r for r in got if r["doc_id"] == 10)
    assert (last["n_base"], last["first_word"], last["last_word"], last["base_labels"]) == (1, 4, 4, "mit")


def brute_print(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, docs_of, real):
    texts = EDGES + [r["text"] for r in list(real.values())[:60]]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(documents(docs_of(texts))).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def brute_components(prints):
    prints, label = np.array(prints, np.uint64), list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return label


@pytest.mark.parametrize("cap", [20000, 3])
def test_links_connect_what_brute_force_connects(spark, cap):
    rnd = random.Random(4)
    seeds, prints = [rnd.getrandbits(64) for _ in range(5)], set()
    for s in seeds:
        for _ in range(14):
            prints.add(s)
            for _ in range(rnd.randrange(1, 4)):
                s ^= 1 << rnd.randrange(64)
    prints = sorted(prints | {0, (1 << 64) - 1, 7, 15})
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(frame, cap=cap).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    root = {r["a"]: r["b"] for r in components.stars(spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in links], "a bigint, b bigint")).collect()}
    groups, brute = defaultdict(set), defaultdict(set)
    for p, b in zip(prints, brute_components(prints), strict=True):
        groups[root.get(simhash.signed(p), simhash.signed(p))].add(p)
        brute[b].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_near_duplicates_edges(spark, docs_of):
    rows = docs_of([None, "", "a b c", "A b  c", "q r s t"], ids=[None, 5, 9, 7, 9])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (9, 7), (7, 7), (9, 9)], key=str)
    assert simhash.near_duplicates(documents(rows).where("false")).count() == 0


def test_sharding(spark, docs_of, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", *[words_text(rnd, rnd.randrange(1, 60)) for _ in range(400)], *["hot copy of one text"] * 300]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    size, slots = Counter(), defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(size) == 24 and max(size.values()) - min(size.values()) < 60 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = [rnd.randrange(100) for _ in range(512)]
    old = sharding.SlotMap.first(8, 512).rebalanced(weights)
    new = old.grown(weights)
    assert new.version == 3 and all(a == b or b == 8 for a, b in zip(old.owner, new.owner, strict=True)) and abs(new.loads(weights)[8] - sum(weights) / 9) < 200


def test_slot_map_is_stored_edited_and_loaded(spark, docs_of, tmp_path):
    rnd = random.Random(9)
    rows = docs_of([words_text(rnd, rnd.randrange(1, 30)) for _ in range(200)]).select("doc_id", F.length("text").alias("size"), F.col("doc_id").alias("group"), F.col("doc_id").alias("spread"))
    folder = str(tmp_path / "map")
    _, one = sharding.assign(rows, 4, folder, slots=256)
    assert one.version == 2 and sharding.SlotMap.load(spark, folder) == one and sharding.SlotMap.load(spark, folder, 1) == sharding.SlotMap.first(4, 256)
    grown = one.grown([1] * 256).store(spark, folder)
    _, two = sharding.assign(rows, 4, folder, slots=256)
    assert sharding.SlotMap.load(spark, folder, 3) == grown and (two.version, two.shards) == (4, 5)
    assert sharding.assign(rows.where("false"), 4, str(tmp_path / "empty"))[0].count() == 0


def test_winnowing_thins_and_shares():
    rnd = random.Random(10)
    run = [rnd.randrange(1 << 60) for _ in range(6)]
    sides = [[rnd.randrange(1 << 60) for _ in range(40)] for _ in range(4)]
    words = [rnd.randrange(4, 9) for _ in range(6)]
    one = line_dedup.winnowed(sides[0] + run + sides[1], [5] * 40 + words + [7] * 40, 20)
    two = line_dedup.winnowed(sides[2] + run + sides[3], [9] * 40 + words + [3] * 40, 20)
    assert set(one[1]) & set(two[1]) and set(sum(one[2], [])) & set(sum(two[2], []))
    assert len(one[0]) < sum(map(len, one[2]))  # fewer fingerprints than stretches
    assert line_dedup.winnowed([], [], 20) == ([], [], []) and line_dedup.winnowed([5], [30], 20)[0] == [0] and line_dedup.winnowed([5], [19], 20) == ([], [], [])


def test_line_dedup_with_clashing_names(spark, docs_of):
    text = "\n".join(f"line {i} with five words more" for i in range(6))
    rows = docs_of([text, f"other\n{text}"]).withColumns({c: F.lit("x") for c in ("runs", "n_lines", "n_removed", "hash")})
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert (got[1]["text"], got[1]["n_lines"], got[1]["n_removed"], got[1]["runs"], got[1]["hash"]) == ("other", 7, 6, "x", "x") and got[0]["text"] == text


def test_lm_base_and_model(spark, real):
    got = {r["doc_id"]: r for r in lm_mixing.op7_lm_scoring(spark, SF).collect()}
    own = lambda t: (t or "").encode().lower().split() + [b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in real}
    c = Counter(t for i, r in real.items() if not held[i] for t in own(r["text"]))
    n = sum(c.values())
    base = model = 0.0
    for i, r in real.items():
        w, g = own(r["text"]), got[i]
        expected = sum(np.log10((c[t] + 1) / (n + len(c) + 1)) for t in w)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (len(w), sum(t in c for t in w), n, held[i])
        assert abs(g["base_score"] - expected) < 1e-6 * max(1, abs(expected)) and g["score"] < 0
        if held[i]:
            base, model = base + g["base_score"], model + g["score"]
    assert model > base


def sorted_words(rnd, n):
    return sorted({bytes(rnd.choice(b"abc\x01!\xc3") for _ in range(rnd.randrange(0, 9))) for _ in range(n)} | {b"c" * 90, b"c" * 91}, key=lambda w: w + b" ")


def test_lm_prefix_counts_equal_brute_force():
    rnd = random.Random(4)
    rows = [(z, w, rnd.randrange(5)) for z in (0, 1) for w in sorted_words(rnd, 300)]
    heads = sorted({(z, (w + b" \0\0\0")[:3]) for z, w, _ in rows})
    sums = [(z, h, float(sum(n for a, w, n in rows if a == z and (w + b" \0\0\0")[:3] == h))) for z, h in heads]
    counts = lm_mixing.head_counts(sums)
    rows.sort(key=lambda r: (r[0], (r[1] + b" \0\0\0")[:3], r[1] + b" "))
    group = np.array([heads.index((z, (w + b" \0\0\0")[:3])) for z, w, _ in rows])
    text = lm_mixing.Spelled([w for _, w, _ in rows], np.array([z for z, *_ in rows]))
    got = lm_mixing.Prefixes(text, [w for _, w, _ in rows], np.array([n for *_, n in rows], float), group, [counts[h] for h in heads])
    bits = lambda w: "".join(f"{b:08b}" for b in (w + b" ")[: lm_mixing.DEPTH])
    want = Counter()
    for z, w, n in rows:
        for p in range(len(bits(w))):
            want[z, bits(w)[: p + 1]] += n
    for i, (z, w, _) in enumerate(rows):
        for p in range(len(bits(w))):
            zeros, ones = (float(x[0]) for x in got.of(p % 8, int(text.starts[i]) + p // 8, int(text.starts[i]) + p // 8 + 1))
            assert (zeros, ones) == (want[z, bits(w)[:p] + "0"], want[z, bits(w)[:p] + "1"])
    long = next(int(text.starts[i]) for i, (_, w, _) in enumerate(rows) if len(w) > 70)
    assert got.of(0, long + 70, long + 71)[0] == 0


def test_lm_bits_add_up():
    m, rng = lm_mixing.Model.new(), np.random.default_rng(1)
    m.zeros[:], m.ones[:] = rng.integers(0, 50, lm_mixing.SLOTS), rng.integers(0, 50, lm_mixing.SLOTS)
    words = sorted([b""] + [bytes([x]) for x in range(256) if x != 32], key=lambda w: w + b" ")
    text = lm_mixing.Spelled(words, np.zeros(256, np.int64))
    cost = m.prepare().costs(text, lm_mixing.Prefixes(text, words, rng.integers(0, 9, 256).astype(float), np.zeros(256, np.int64), [np.zeros((2, 0), np.float32)]))
    assert (cost < 0).all() and (10.0**cost).sum() <= 1 + 1e-4
    one, two = lm_mixing.Spelled([b"ab", b"ab"], np.array([0, 1])), lm_mixing.Spelled([b"x" * 70_000 + b"ab"], np.array([0]))
    for _, slots in one.bits(0, 6):
        assert (slots[1, :3] == slots[1, 3:]).all() and (slots[0, :3] != slots[0, 3:]).any()
    parts = [list(two.bits(a, b)) for a, b in two.windows(1000)]
    for b, (_, slots) in enumerate(two.bits(0, 70_003)):
        assert (np.concatenate([x[b][1] for x in parts], axis=1) == slots).all()


def test_lm_followers_equal_brute_force():
    rnd = random.Random(5)
    texts = [[rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randrange(60))] + [b""] for _ in range(20)]
    got = lm_mixing.Followers(lm_mixing.Indexed(texts))
    names, i = list(dict.fromkeys(t for own in texts for t in own)), 0
    for own in texts:
        last2, last1 = {}, {}
        for j, t in enumerate(own):
            c1 = own[j - 1] if j else None
            c2 = (own[j - 2] if j > 1 else None, c1)
            assert got.before[0][i] == (c2 in last2) and got.before[1][i] == (c1 in last1)
            if c2 in last2:
                assert names[got.next[0][i]] == last2[c2] and got.hits[0][i] == (last2[c2] == t)
            asked = c1 in last1 and not (c2 in last2 and (last2[c2] == t or last2[c2] == last1[c1]))
            assert got.asked[1][i] == asked and got.hits[1][i] == (asked and last1[c1] == t)
            last2[c2] = last1[c1] = t
            i += 1


def test_lm_edges(spark, docs_of):
    rows = docs_of([*EDGES, ("bonjour la", None)]).withColumn("held_out", F.lit(False))
    out = {r["doc_id"]: r for r in lm_mixing.scored(rows.select("doc_id", "text", "lang", "held_out")).collect()}
    assert len(out) == len(EDGES) + 1 and out[0]["n_tokens"] == out[1]["n_tokens"] == 1
    none = lm_mixing.scored(rows.withColumn("held_out", F.lit(True)).select("doc_id", "text", "lang", "held_out")).collect()
    assert len(none) == len(EDGES) + 1 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in none)
    assert lm_mixing.scored(rows.where("false").select("doc_id", "text", "lang", "held_out")).count() == 0


def test_decontamination(spark, docs_of):
    rnd = random.Random(6)
    items = [words_text(rnd, n) for n in (13, 20, 40, 60, 8)]
    changed = items[2].split()
    for k in (7, 15, 23, 31, 38):
        changed[k] = "zzz"
    far = [w if k % 3 else "zzz" for k, w in enumerate(items[3].split())]
    filler = lambda: words_text(rnd, 80)
    texts = [filler(), f"{filler()} {items[0]} {filler()}", f"{filler()}, {items[1].upper()}! {filler()}", f"{' '.join(changed)} {filler()}", f"{filler()} {' '.join(far)}", f"{filler()} {' '.join(items[3].split()[20:45])}", None, "", items[4], f"{items[0]} {filler()} {items[0]}", " ".join(items[2].split()[:9])]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id bigint, text string")
    found = decontaminate.overlaps(documents(docs_of(texts)), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 0), (2, 1), (3, 2), (5, 3), (8, 4), (9, 0)}
    assert sum(r["doc_id"] == 9 for r in found) == 2 and all(r["n_same"] >= 0.8 * r["n_words"] for r in found)
    joined = decontaminate.overlaps(documents(docs_of(texts)), bench, broadcast_rows=0).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, found))
    assert decontaminate.overlaps(documents(docs_of(texts)), bench.where("false")).count() == 0


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(400):
        same = rng.random(rng.integers(0, 40)) < rng.choice([0.3, 0.7, 0.85])
        brute = max((b - a for a in range(len(same)) for b in range(a, len(same) + 1) if 5 * same[a:b].sum() >= 4 * (b - a)), default=0)
        a, b, n = decontaminate.longest_stretch(same, 0.8)
        assert (b - a, n) == (brute, same[a:b].sum()) and 5 * n >= 4 * (b - a)


def test_every_passage_with_four_fifths_alike_has_a_seed():
    for n in range(6, 21):
        for changed in combinations(range(n), n // 5):
            equal = [k not in changed for k in range(n)]
            assert any(all(equal[at + j] for j, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for at in range(n - len(m) + 1)), (n, changed)


def test_decontamination_finds_substitutions(spark, docs_of):
    rnd = random.Random(7)
    items, texts, expected = [[f"w{n}x{k}" for k in range(n)] for n in (13, 15, 20, 25)], [], set()
    for _ in range(300):
        i = rnd.randrange(4)
        words, n = list(items[i]), len(items[i])
        wrong = rnd.randrange(1, n // 5 + 2)
        for k in rnd.sample(range(n), wrong):
            words[k] = "zzz"
        alike = [w != "zzz" for w in words]
        if any(5 * sum(alike[a:b]) >= 4 * (b - a) for a in range(n) for b in range(a + 13, n + 1)):
            expected.add((len(texts), i))
        texts.append(f"foreign words before {' '.join(words)} foreign words after")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.overlaps(documents(docs_of(texts)), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and 0 < len(expected) < len(texts)


def test_decontamination_finds_short_items(spark, docs_of):
    items, texts, expected = [[f"s{n}x{k}" for k in range(n)] for n in range(1, 13)], [], set()
    for i, words in enumerate(items):
        for k in range(-1, len(words)):
            if 5 * (len(words) - (k >= 0)) >= 4 * len(words):
                expected.add((len(texts), i))
            texts.append(f"foreign before {' '.join('zzz' if j == k else w for j, w in enumerate(words))} foreign after")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.overlaps(documents(docs_of(texts)), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and 0 < len(expected) < len(texts)


def test_packing(spark, docs_of):
    rnd = random.Random(7)
    texts = EDGES + [words_text(rnd, rnd.randrange(1, 400)) for _ in range(300)] + ["don't stop... ÉTÉ! ΣΟΦΟΣ 3rd <|endoftext|> İ a b"]
    got = packing.packed_documents(documents(docs_of(texts)), capacity=1000).collect()
    from tokenizers import Tokenizer

    t, by_doc, bins = Tokenizer.from_file(packing.vocabulary_path()), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    total = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        pieces = [(k, s, len(ids[s : s + 1000]), zlib.crc32(ids[s : s + 1000].tobytes())) for k, s in enumerate(range(0, len(ids), 1000))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == pieces
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1000
    assert len(bins) <= -(-total // 1000) + 2


def test_packing_levels_lose_nothing(spark):
    rnd = random.Random(8)
    sizes = [rnd.randrange(1, 101) for _ in range(900)]
    items = spark.createDataFrame(list(enumerate(sizes)), "pid bigint, length bigint")
    got = packing.pack(items, capacity=100, block=128, generations=8).collect()
    assert sorted(r["pid"] for r in got) == list(range(900))
    held = Counter()
    for r in got:
        held[r["sequence_id"]] += sizes[r["pid"]]
    whole = packing.Bins(sizes, 100)
    whole.best_fit(sorted(range(900), key=lambda i: -sizes[i]))
    assert max(held.values()) <= 100 and len(held) <= 1.04 * len(whole.bins), (len(held), len(whole.bins))
    assert packing.pack(items.where("false")).count() == 0


def runs_brute(texts, least):
    """Lines in maximal runs of ``least`` words or more that equal lines of an earlier place, for texts in order."""
    lines = [[(n, tuple(x.split())) for n, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    gone = [set() for _ in texts]
    for b, new in enumerate(lines):
        for a in range(b + 1):
            old = lines[a]
            for i in range(len(new)):
                for j in range(len(old)):
                    if (a, j) < (b, i) and new[i][1] == old[j][1] and not (i and j and new[i - 1][1] == old[j - 1][1]):
                        k = 0
                        while i + k < len(new) and j + k < len(old) and new[i + k][1] == old[j + k][1]:
                            k += 1
                        if sum(len(x) for _, x in new[i : i + k]) >= least:
                            gone[b] |= set(range(new[i][0], new[i + k - 1][0] + 1))
    return gone


def stretches_brute(texts, least):
    """Lines in a shortest stretch of ``least`` words that stands at an earlier place, for texts in order."""
    seen, gone = set(), [set() for _ in texts]
    for b, t in enumerate(texts):
        lines = [(n, tuple(x.split())) for n, x in enumerate((t or "").split("\n")) if x.split()]
        for end in range(len(lines)):
            start = max((s for s in range(end + 1) if sum(len(x) for _, x in lines[s : end + 1]) >= least), default=None)
            if start is None:
                continue
            key = tuple(x for _, x in lines[start : end + 1])
            if key in seen:
                gone[b] |= {n for n, _ in lines[start : end + 1]}
            seen.add(key)
    return gone


def test_line_dedup_between_brute_force_bounds(spark, docs_of):
    rnd = random.Random(9)
    bag = [words_text(rnd, rnd.randrange(1, 9)) for _ in range(9)] + ["", "  "]
    texts = [None, ""] + ["\n".join(rnd.choice(bag) for _ in range(rnd.randrange(1, 14))) for _ in range(50)]
    docs = documents(docs_of(texts))
    got = defaultdict(set)
    for r in line_dedup.repeated_runs(docs, min_words=8).collect():
        for first, last in r["runs"]:
            got[r["doc_id"]] |= {n for n in range(first, last + 1) if texts[r["doc_id"]].split("\n")[n].split()}
    every, sure = runs_brute(texts, 8), stretches_brute(texts, 8)
    assert sum(map(len, sure)) > 40 and all(sure[i] <= got[i] <= every[i] for i in range(len(texts)))
    for r in line_dedup.dedup_lines(docs, min_words=8).collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        if texts[r["doc_id"]] is None or not got[r["doc_id"]]:
            assert r["text"] == texts[r["doc_id"]] and r["n_removed"] == 0
        else:
            assert [x for x in r["text"].split("\n") if x.split()] == [x for n, x in enumerate(lines) if x.split() and n not in got[r["doc_id"]]]


def test_line_dedup_finds_every_run_of_enough_words(spark, docs_of):
    rnd = random.Random(10)
    common = words_text(rnd, 3)
    passage = [words_text(rnd, 8), common, words_text(rnd, 9), words_text(rnd, 7)]
    own = lambda: "\n".join([words_text(rnd, 6), common, words_text(rnd, 5)])
    texts = [f"{common}\n{own()}", *[f"{own()}\n" + "\n".join(passage) + f"\n{own()}" for _ in range(20)], own()]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(docs_of(texts))).collect()}
    assert got[0]["n_removed"] == got[1]["n_removed"] == got[21]["n_removed"] == 0
    assert all(got[i]["n_removed"] == 4 and passage[0] not in got[i]["text"] for i in range(2, 21))


def test_fold_matches_crc32(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, before, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    assert before.count() > 800
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
