"""The stages against plain Python, each on the rows that its predecessor kept."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from maskwell.llm import rule_ensemble, secrets
from tests.llm.test_dartminhash import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.orderBy(F.desc("n_chars")).limit(5).select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat(F.reverse("text"), F.lit(" password=hunter2hunter2 end")).alias("text"), "lang", "source", "n_chars")
    docs = docs.union(own)
    docs_schema, columns, seen = docs.schema, docs.columns, [docs.collect()]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append(docs.collect())
    raw, good, single, masked, mixed, packed = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in rule_ensemble.quality(spark.createDataFrame(raw, docs_schema), labels).collect()}
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in raw if scores[r.doc_id] >= 0.7)
    assert sorted(r.doc_id for r in single) == sorted({c for _, c, _ in brute([(r.doc_id, r.text) for r in good])})
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in single)
    before = {r.doc_id: r.text for r in single}
    assert any(r.text != before[r.doc_id] for r in masked)
    for r in masked:
        spans = secrets.scan(before[r.doc_id])[1]
        assert (r.text == before[r.doc_id]) == (not spans) and all(before[r.doc_id][a:b] not in r.text for a, _, b in spans)
    size = {r.doc_id: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in masked}
    totals, taken = defaultdict(int), defaultdict(int)
    for r in masked:
        totals[r.source] += size[r.doc_id]
    copies = Counter(r.doc_id for r in mixed)
    for r in masked:
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
        assert copies[r.doc_id] <= 3
    total, weights = sum(totals.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(totals))}
    targets, free = {}, dict(weights)
    while True:
        left = (total - sum(targets.values())) / sum(free.values())
        over = [s for s in free if free[s] * left >= 3 * totals[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3 * totals[s]
            del free[s]
    targets |= {s: w * left for s, w in free.items()}
    for s in totals:
        assert abs(taken[s] - targets[s]) <= max(size[r.doc_id] for r in masked if r.source == s)
    check(packed, [(r.doc_id, r.text) for r in mixed], 2048)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}
    assert corpus_pipeline.run(spark, SF).count() > 0
