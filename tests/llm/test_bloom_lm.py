import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskwell.llm import bloom_lm


def brute(rows):
    """Base figures of (doc_id, text) rows, as literally as they are stated."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda k: zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((k if k is not None else -1, held(k), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 5)) for k, t in rows)


def ours(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect())


@pytest.mark.parametrize("broadcast", [bloom_lm.BROADCAST, -1])
@pytest.mark.parametrize("head", [1 << 20, 5])
def test_base_matches_brute_force(spark, head, broadcast):
    rng = random.Random(3)
    vocabulary = ["The", "the", "ÉTÉ", "été", "a", "b\x85c", "x y", "é"] + [f"w{k}" for k in range(60)]
    rows = [(k, rng.choice([" ", "\n", "\t  "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (7, rows[7][1]), (502, "word " * 50000), (None, "nothing known"), (9, "unseen9 unseen9"), (503, rows[7][1])]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double").repartition(4)
    assert ours(bloom_lm.score(df, broadcast, head_words=head)) == brute(rows)
    assert bloom_lm.score(df.limit(0), broadcast).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 48, 20000).astype(np.uint64)
    counts = rng.integers(1, 5000, 20000)
    want = np.floor(np.log2(counts)).astype(int) + 1
    full = bloom_lm.bits_of(keys, want)
    got = bloom_lm.levels(full, keys)
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert (bloom_lm.levels(full, rng.integers(0, 1 << 48, 20000).astype(np.uint64)) > 0).mean() < 0.02
    assert abs(bloom_lm.middle(np.array([0, 1, 2, 3])) - [0, 1, 2.5, 5.5]).max() == 0


def test_every_pair_is_held(spark):
    """Pairs of any words and counts are found at their level, in shards of any number; false hits are rare."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = bloom_lm.plain_documents(docs).where("NOT held_out")
    texts = [r.raw for r in plain.collect()]
    c = Counter(p for t in texts for p in zip([b"", *t.lower().split()], [*t.lower().split(), b""]))
    for n in (1, 64, 1000):
        shards = {r.shard: r for r in bloom_lm.built(bloom_lm.gathered(plain, n)).collect()}
        model = bloom_lm.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), n, 0, 0)
        asked = bloom_lm.Asked(model, texts)
        got = [bloom_lm.answered((shards[s].words, shards[s].counts, shards[s].bits), w, p) for s, w, p in asked.questions()]
        level = np.concatenate([x[1] for x in got])[asked.pair_at]
        want = [math.floor(math.log2(c[p])) + 1 for t in texts for p in zip([b"", *t.lower().split()], [*t.lower().split(), b""])]
        assert (level >= want).all() and (level == want).mean() > 0.98


def test_both_ways_agree_with_the_stated_probability(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]
    words = lambda t: [*t.encode().lower().split(), b""]
    train = [words(t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"", *t[:-1]], t))
    norm = sum(c.values()) + len(c) + 1

    def probability(v, w):
        level = math.floor(math.log2(pairs[v, w])) + 1 if pairs[v, w] else 0
        seen = min((2 ** (level - 1) + 2**level - 1) / 2 if level else 0, c[v])
        return math.log10((seen + bloom_lm.PRIOR * (c[w] + 1) / norm) / (c[v] + bloom_lm.PRIOR))

    want = {k: sum(probability(v, w) for v, w in zip([b"", *words(t)[:-1]], words(t))) for k, t in rows}
    one, two = (sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in bloom_lm.score(docs, size, head_words=500).collect()) for size in (1 << 30, -1))
    assert one == two
    # false hits, one in a hundred, only raise a level
    assert np.mean([abs(r[3] - want[r[0]]) < 0.02 * abs(want[r[0]]) + 0.5 for r in one]) > 0.9


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = bloom_lm.score(docs)
    assert ours(got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in held)
