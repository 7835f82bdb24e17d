import random
from collections import defaultdict

import numpy as np
import pytest

from maskwell.llm import dartminhash as dart


def sets_of(text, weighting="count"):
    """The five-word shingles; by count, the n-th time of a shingle is an element of its own."""
    w, seen = (text or "").encode().lower().split(), defaultdict(int)
    found = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    if weighting == "set":
        return frozenset(found)
    for s in found:
        seen[s] += 1
    return frozenset((s, k) for s, n in seen.items() for k in range(n))


def brute(rows, similarity=0.8, weighting="count"):
    """Classes by comparing every pair."""
    sets = [sets_of(t, weighting) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                up[root(i)] = root(j)
    classes = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        classes[root(k)].append(doc_id)
    return sorted((d, min(c), len(c)) for c in classes.values() for d in c)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(rng):
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.randrange(1, 25)):
            rows.append((k, " ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 40))))))
            k += 1
    rows += [(k + j, t) for j, t in enumerate([None, "", "  \n", "one two", "One  two", "one two three", "word " * 3000, "word " * 3001])]
    rows += [rows[0], rows[0]]
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus(random.Random(11))
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, class_id string").repartition(6)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in dart.near_duplicates(docs).collect())
    assert got == brute(rows)
    kept = dart.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})
    assert dart.near_duplicates(docs.limit(0)).count() == 0 and dart.without_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_large_buckets_need_rounds(spark, monkeypatch, weighting):
    monkeypatch.setattr(dart, "SMALL", 1)
    monkeypatch.setattr(dart, "SMALL_NEXT", 2)
    monkeypatch.setattr(dart, "FAN", 3)
    rows = corpus(random.Random(12))
    lines = "the same old line of words again and again"
    rows += [(5000 + k, " ".join([lines] * k)) for k in (1, 2, 30, 31, 40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in dart.near_duplicates(docs, weighting=weighting).collect()) == brute(rows, weighting=weighting)


def one_group(n, seed):
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for k in range(n):
        words = edited(rng, base, rng.randrange(0, 11))
        cut = rng.choice([0, 0, 0, 10, 25, 40])
        rows.append((k, " ".join(words[: len(words) - cut])))
    return rows


def test_one_group_of_many_edits(spark):
    """Copies of one text with up to ten edits or cuts: links exist between some, far from all, of them."""
    rows = one_group(150, 13)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in dart.near_duplicates(docs).collect()) == brute(rows)


def test_comparisons_grow_with_rows(spark, monkeypatch):
    """Comparisons for a group of near copies follow its size, not the square of it."""
    made, compared = [], dart.compared

    def counting(pairs, *args):
        made[-1] += pairs.count()
        return compared(pairs, *args)

    monkeypatch.setattr(dart, "compared", counting)
    for n in (100, 500):
        rows = one_group(n, 14)
        made.append(0)
        got = dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == brute(rows)
    assert made[1] < 9 * made[0], made


def test_recall_of_every_fiftieth_id(spark):
    """Of the similar pairs between ids divisible by 50 and all rows, the share that one class holds: all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, sets_of(r.text)) for r in docs.collect()]
    place = {r.doc_id: r.class_id for r in dart.near_duplicates(docs).collect()}
    pairs = [(a, b) for a, x in rows if a % 50 == 0 for b, y in rows if a != b and x and y and len(x & y) >= 0.8 * len(x | y)]
    found = sum(place[a] == place[b] for a, b in pairs)
    print(f"recall {found} of {len(pairs)}")
    assert pairs and found >= 0.99 * len(pairs)


@pytest.mark.parametrize("scale", [1.0, 0.5, 3.0])
def test_signatures_estimate_weighted_similarity(scale):
    rng = np.random.default_rng(4)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.9):
        a = scale * rng.integers(1, 5, 300)
        b = np.where(rng.random(300) < share, a, scale * rng.integers(1, 5, 300))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = dart.signatures([elements, elements[::-1]], [a, b[::-1]], 2048)
        errors.append(abs((s[0] == s[1]).mean() - true))
    assert max(errors) < 0.05
    assert (dart.signatures([np.zeros(0, np.uint64)], [np.zeros(0)], 16) == 0).all()


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 200)]
    got = {r.node: r.label for r in dart.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


def test_components_need_steps(spark):
    edges = [(1, 10), (10, 5), (5, 20), (20, 2), (2, 30), (30, 0), (7, 8), (8, 3), (3, 9), (9, 4)]
    got = {r.node: r.label for r in dart.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([0, 1, 2, 5, 10, 20, 30], 0), **dict.fromkeys([3, 4, 7, 8, 9], 3)}


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in dart.near_duplicates(docs).collect()) == brute(rows)
