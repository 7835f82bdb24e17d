import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.llm import labelled, rule_ensemble, toxicity


def made(rng, n=600):
    words = ["alpha", "beta", "gamma", "delta", "omega", "trash can", "idea"]
    docs, labels = [], []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60)))
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            text += " " + rng.choice(["you idiot", "what trash", "you 1d1ot", "you іdiоt", "you ID!OT"])
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((k, text, 1.5))
        labels.append((k, int(not junk), int(toxic)))
    docs += [(9000, None, 0.0), (9001, "", 0.0), (9002, "word " * 50000, 0.0), (0, docs[0][1], 0.0), (None, "null id", 0.0)]
    return docs, [*labels, (3, None, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made(random.Random(5))
    return spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert toxicity.folded("You 1D10T, а-Ьoy!") == " you idiot a boy "
    assert toxicity.folded("m0r0n 2024 v1.0 a$$ a55 trash3") == " moron 2024 v 1 0 ass ass trash 3 "
    assert toxicity.folded("ｉｄｉｏｔ id​iot 𝓲𝓭𝓲𝓸𝓽 íďïöt ıdıot ІДІОТ мoron") == " idiot" * 6 + " moron "
    assert toxicity.folded("") == "  "


def plain_features(lexicon, text):
    """The features from every place at which a term begins, without an automaton."""
    text = toxicity.folded(text)
    places = lambda t: [(k, k + len(t) - 1) for k in range(len(text)) if text.startswith(t, k)]
    exempt = [p for phrase in lexicon.exceptions for p in places(f" {phrase} ")]
    total = sum(w for t, w in lexicon.weights.items() for a, b in places(t) if not any(c <= a and b <= d for c, d in exempt))
    return np.log1p(total), min(1.0, total / max(1, len(text.split()))), float(total > 0)


def test_scores_equal_brute_force(spark, tables):
    docs, labels = tables
    lexicon = toxicity.learnt(docs, labels)
    assert lexicon.weights
    rng, bits = random.Random(8), ["idiot", "1d1ot", "trash", "trash can", "tr4sh", "moron", "idea", "ІДІОТ", "a", "!!", "can"]
    texts = [None, "", "trash can idiot " * 3000] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = toxicity.weighed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()
    for r in rows:
        if r.doc_id != 2:
            want = plain_features(lexicon, texts[r.doc_id] or "")
            assert np.allclose((r.f0, r.f1, r.f2), want)
            z = float(np.dot(lexicon.regression, [*want, 1.0]))
            assert r.score == pytest.approx(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idio": 3.0}, ("trash can",), [1.0, 1.0, 1.0, -1.0])
    automaton = lexicon.automaton()
    assert lexicon.features("a trash can", automaton) == (0.0, 0.0, 0.0)
    one, two = lexicon.features("trash", automaton), lexicon.features("trash " + "word " * 99, automaton)
    assert one[0] == two[0] and one[1] > two[1]
    assert lexicon.features("a trash can of idiots", automaton)[0] == pytest.approx(np.log1p(3.0))


@pytest.mark.parametrize("operator,label,least", [(toxicity.toxicity, "toxic", 0.95), (rule_ensemble.quality, "quality", 0.99)])
def test_held_out_accuracy(tables, operator, label, least):
    docs, labels = tables
    got = operator(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = got.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least
    twice = [r for r in rows if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert operator(docs.limit(0), labels).count() == 0
    assert operator(docs.limit(5), labels.limit(0)).count() == 5


def test_columns_equal_numpy(tables):
    """The compiled expression scores like the rules applied in numpy."""
    docs, labels = tables
    model = rule_ensemble.learnt(docs, labels)
    rows = docs.select(rule_ensemble.statistics(F.coalesce("text", F.lit(""))).alias("s")).select("s.*", model.column(F.col("s")).alias("score")).toPandas()
    x = rows[list(rule_ensemble.STATISTICS)].to_numpy()
    z = model.intercept + sum(w * r.holds(x) for r, w in model.rules)
    assert model.rules and np.allclose(rows["score"], 1 / (1 + np.exp(-z)))
    assert len(model.rules) < 60 and any(len(r.parts) > 1 for r, _ in model.rules)


def test_held_out_rows_are_not_learnt_from(tables):
    docs, labels = tables
    got = labelled.training_rows(docs, labels, "toxic", 100)
    ids = [r.doc_id for r in got.collect()]
    assert len(set(ids)) == 100 and not any(zlib.crc32(str(k).encode()) % 4 == 2 for k in ids)
    kept = rule_ensemble.good_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
