"""Graph search and insertion against exact search; full codes, codec, exports and helpers against plain Python."""

import json
import random

import numpy as np
import pytest

from maskwell.functions import codec, wide
from maskwell.functions import distance as D
from maskwell.operators import rules, state
from maskwell.plans import hnsw
from maskwell.plans.index import Index
from maskwell.sources import fixtures as X
from maskwell.sources import interchange

SF = "/root/testdata/sf0.01"


def test_graph_search_recall(spark):
    graph = hnsw.built(spark, SF)
    queries = X.requests(hnsw.left_codes(spark, SF))
    n = X.database(hnsw.left_codes(spark, SF)).count()
    assert graph.codes.count() == n and graph.edges.count() == graph.edges.distinct().count()
    degrees = graph.edges.groupBy("layer", "src").count().collect()
    assert all(r["count"] <= (4 if r.layer == 0 else 2) * graph.params.m for r in degrees)
    assert {r.src for r in degrees if r.layer == 0} == {r.serial for r in graph.codes.collect()}
    exact = Index(graph.codes).search(queries, 3).select("req", "serial")
    found = graph.search(queries, 3)
    assert found.count() == exact.count()
    recall = found.join(exact, ["req", "serial"]).count() / exact.count()
    print(f"recall {recall:.3f}")
    assert recall >= 0.9
    gone = graph.codes.where("serial % 5 = 0")
    smaller = graph.delete(gone)
    assert smaller.search(queries.limit(5), 3).where("serial % 5 = 0").count() == 0
    assert smaller.edges.where("src % 5 = 0 OR dst % 5 = 0").count() == 0


def test_first_batch_and_empty_graph(spark):
    codes = X.database(hnsw.left_codes(spark, "/root/testdata/sf0.001"))
    empty = hnsw.Graph(codes.limit(0).selectExpr("*", "0L AS layer"), spark.createDataFrame([], "layer long, src long, dst long"))
    graph = empty.insert(codes)
    assert graph.codes.count() == codes.count() and graph.edges.count() > 0


def code(rng):
    return rng.integers(0, 2, D.CODE_BITS).astype(np.uint8), (rng.random(D.CODE_BITS) < 0.8).astype(np.uint8)


@pytest.mark.parametrize("rotations,normalised", [(1, False), (31, False), (31, True), (11, False)])
def test_full_codes(spark, monkeypatch, rotations, normalised):
    monkeypatch.setattr(wide, "PASS_QUERIES", 3)
    rng = np.random.default_rng(1)
    queries = [code(rng) for _ in range(4)]
    db = [code(rng) for _ in range(5)] + [(D.rotate(queries[0][0], 4), D.rotate(queries[0][1], 4)), (queries[1][0], np.zeros(D.CODE_BITS, np.uint8))]
    pack = lambda rows: [(k, np.packbits(c).tobytes(), np.packbits(m).tobytes()) for k, (c, m) in enumerate(rows)]
    got = wide.least_distances(spark.createDataFrame([*pack(db), (99, None, None)], "serial long, code binary, mask binary"), spark.createDataFrame(pack(queries), "req long, code binary, mask binary"), rotations, normalised)
    rows = {(r.req, r.serial): (r.hd, r.md) for r in got.collect()}
    assert len(rows) == len(queries) * len(db)
    for i, (c, m) in enumerate(queries):
        for j, (dc, dm) in enumerate(db):
            assert rows[i, j] == D.least_rotation(dc, dm, c, m, rotations, normalised)
    assert rotations == 1 or rows[0, 5][0] == 0
    assert rows[0, 6] == (65535, 65535)


def test_mirror_and_bits():
    rng = np.random.default_rng(2)
    c, m = code(rng)
    again = wide.mirrored(*wide.mirrored(c, m))
    assert (again[0] == c).all() and (again[1] == m).all()
    order = wide.mirror_order()
    for k in (0, 1, 399, 400, 401, 799, 800, 12799):
        row, column, rest = k // 800, k % 800 // 4, k % 4
        flipped = 99 - column if column < 100 else 299 - column
        assert order[k] == row * 800 + flipped * 4 + rest
    place = wide.storage_order()
    assert sorted(place) == list(range(D.CODE_BITS))
    for new in (0, 1, 5, 6400, 3200, 801, 12799):
        b, w, r1, col, r2 = new // 6400, new % 6400 // 3200, new % 3200 // 800, new % 800 // 4, new % 4
        assert place[new] == 800 * (r2 * 4 + r1) + col * 4 + w * 2 + b
    raw = np.packbits(c).tobytes()
    for k in (0, 7, 8, 12799):
        assert wide.get_bit(raw, k) == c[k]
        assert wide.get_bit(wide.with_bit(raw, k, True), k) == 1 and wide.get_bit(wide.with_bit(raw, k, False), k) == 0
        assert wide.get_bit(wide.with_bit(raw, k), k) == 1 - c[k] and wide.with_bit(wide.with_bit(raw, k), k) == raw


def test_noise():
    rng = np.random.default_rng(3)
    c, m = code(rng)
    out = wide.graded(c, m, 500, 7)
    assert (out != c).sum() == 500 and not ((out != c) & (m == 0)).any()
    assert (wide.graded(c, m, 10**6) != c).sum() == m.sum()
    nc, nm = wide.noisy(c, m, 0.1, 0.05, 8)
    assert abs((nc != c).mean() - 0.1) < 0.02 and abs((nm != m).mean() - 0.05) < 0.02
    assert ((nm != m)[0::2] == (nm != m)[1::2]).all()
    v = rng.integers(-8, 8, 5000)
    moved = wide.noisy_nibbles(v, 0.3, 9)
    assert np.abs(moved - v).max() == 1 and moved.min() >= -8 and moved.max() <= 7


def test_codec():
    assert codec.encode([]) == bytes(3) and codec.decode(bytes(3)) == []
    # gaps 0, 0 and 2 plainly: ones for 0, two zeros and a one for 2
    assert codec.encode([0, 1, 4]) == bytes([3, 0, 0, 0b11001000])
    rng = random.Random(4)
    for _ in range(200):
        ids = sorted(rng.sample(range(rng.choice([50, 10**4, 2**32 - 1])), rng.randrange(1, 50)))
        assert codec.decode(codec.encode(ids)) == ids
    with pytest.raises(ValueError):
        codec.encode([3, 3])


def test_expected_subset():
    actual = {"a": 1, "b": {"c": [1, 2], "d": None}}
    assert rules.mismatches(actual, {"b": {"d": None}}) == [] and rules.mismatches(actual, {}) == []
    assert len(rules.mismatches(actual, {"a": 2, "b": {"c": [2, 1], "e": 0}})) == 3


def test_exports_and_results(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS last_modified_at FROM range(10)")
    out = str(tmp_path / "out")
    state.export(rows, out)
    state.export(rows, out)
    assert spark.read.parquet(out).count() == 10
    state.export(rows, out, "2024-01-08")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9, 9]
    state.publish(spark.sql("SELECT id, IF(id % 2 = 0, 'uniqueness', 'reauth') AS message_type FROM range(6)"), str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).where("message_type = 'reauth'").count() == 3


def test_knn_file(spark, tmp_path):
    path = tmp_path / "knn.json"
    path.write_text("\n".join([json.dumps({"engine": "naive", "k": 2}), json.dumps({"node": 1, "neighbors": [2, 3]}), json.dumps({"node": 2, "neighbors": []})]))
    assert sorted((r.node, r.neighbors) for r in interchange.read_knn(spark, str(path)).collect()) == [(1, [2, 3]), (2, [])]
