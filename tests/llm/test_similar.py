"""Groups of similar texts against brute force over all pairs."""

import random

import pytest

from quillstone.llm import simhash, similar


def brute_sets(texts, width=5):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        n = max(1, len(words) - width + 1)
        out.append({tuple(words[i : i + width]) for i in range(n)})
    return out


def brute_groups(texts, least=0.8):
    sets, root = brute_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts(rnd, originals=12, copies=14):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(originals):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 260))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(copies)):
            changed = list(base)
            for _ in range(rnd.randrange(0, 6)):
                changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
            texts.append(" ".join(changed) if rnd.random() < 0.9 else " ".join(base).upper())
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(1, 500_000), (2, 0)])
def test_groups_equal_brute_force(spark, docs_of, seed, broadcast_rows):
    texts = near_texts(random.Random(seed))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs_of(texts).select("doc_id", "text"), broadcast_rows=broadcast_rows).collect()}
    want = brute_groups(texts)
    assert len(set(want)) < len(texts)
    missed = [i for i in range(len(texts)) if got[i] != want[i]]
    assert all(want[got[i]] == want[i] for i in range(len(texts))), "a link that brute force hasn't"
    assert len(missed) <= 0.02 * len(texts)


def test_edges(spark, docs_of):
    texts = [None, "", " \n", "a b", "A  b", "a b c", "x " * 5000, "x " * 5000, "one two three four five six"]
    rows = docs_of(texts, ids=[0, 1, 2, 3, 4, 5, 6, None, 8])
    got = sorted(((r["doc_id"], r["component_id"]) for r in similar.similar_groups(rows.unionByName(rows.where("doc_id = 8"))).collect()), key=str)
    assert got == sorted([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (None, 6), (8, 8), (8, 8)], key=str)
    assert similar.similar_groups(rows.where("false")).count() == 0


def test_pipeline_drops_groups_of_fingerprints_and_of_shingles(spark, docs_of):
    import corpus_pipeline

    rnd, prints = random.Random(7), lambda t: simhash.fingerprint(t.encode())
    base = [f"w{rnd.randrange(5000)}" for _ in range(900)]

    def changed(words, places):
        out = list(words)
        for at in places:
            out[at] = f"n{rnd.randrange(10**6)}"
        return out

    def similarity(a, b):
        one, two = brute_sets([" ".join(a), " ".join(b)])
        return len(one & two) / len(one | two)

    far = lambda a, b: (prints(" ".join(a)) ^ prints(" ".join(b))).bit_count()
    close = next(c for c in (changed(base, range(rnd.randrange(30), 900, 38)) for _ in range(3000)) if far(base, c) <= 3)
    alike = next(c for c in (changed(close, range(0, 900, 70)) for _ in range(3000)) if far(close, c) > 3 and far(base, c) > 3)
    assert similarity(base, close) < 0.8 <= similarity(close, alike) and similarity(base, alike) < 0.8
    other = [f"o{rnd.randrange(5000)}" for _ in range(300)]
    rows = docs_of([" ".join(x) for x in (base, close, alike, other, other)], ids=[3, 5, 4, 9, None])
    kept = sorted((r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()), key=str)
    assert kept == [3, 9, None]
