"""Truth tables of decisions, versions, logs and files."""

import json

import numpy as np

from maskwell.operators import changelog, decisions, graphs
from maskwell.plans.index import Index, SearchParams
from maskwell.sources import interchange


def test_decisions_depend_on_earlier_ones(spark):
    rows = [
        (0, 0, 10, "uniqueness", False, False, False, []),
        (0, 1, 11, "uniqueness", False, False, False, [0]),  # blocked by an insert
        (0, 2, 12, "uniqueness", False, False, False, [1]),  # its match does not mutate
        (0, 3, 13, "uniqueness", True, False, False, []),
        (0, 4, 14, "uniqueness", False, False, False, [3]),  # skipped inserts block nobody
        (0, 5, 15, "reauth", False, False, True, []),
        (0, 6, 16, "uniqueness", False, False, False, [5]),  # blocked by an update
        (0, 7, 17, "reset_check", False, True, False, []),
        (0, 8, 18, "uniqueness", False, True, False, []),
        (0, 9, 19, "uniqueness", False, False, False, [10]),  # a later request blocks nobody
        (0, 10, 20, "reauth", False, False, False, []),
    ]
    df = spark.createDataFrame(rows, "batch long, pos long, req long, request_type string, skip boolean, has_match boolean, reauth_ok boolean, earlier array<long>")
    got = {r.pos: r.decision for r in decisions.decide(df).collect()}
    assert got == {0: "insert", 1: "none", 2: "insert", 3: "insert_skipped", 4: "insert", 5: "update", 6: "none", 7: "none", 8: "none", 9: "insert", 10: "none"}


def test_upsert_bumps_on_change_only(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, None, 4), (3, "c", 1)], "id long, p string, version long")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (9, "z")], "id long, p string")
    got = {r.id: (r.p, r.version) for r in changelog.upsert(old, new, "id", ["p"]).collect()}
    assert got == {1: ("a", 0), 2: ("b", 5), 3: (None, 2), 9: ("z", 0)}


def test_version_join_reasons(spark):
    rows = [(1, 0, 1, 0, 0), (2, None, 1, 0, 0), (3, 0, 1, 1, 1), (4, 2, 1, 1, 1), (5, 1, 2, 1, 1), (6, 1, 1, 1, None), (7, 1, 1, 1, 0), (8, 1, 1, None, 1)]
    got = {r.serial: (r.graph_reason, r.row_reason, r.source_missing) for r in changelog.version_join(spark.createDataFrame(rows, "serial long, g long, g_n long, s long, h long")).collect()}
    assert got[1] == (None, None, False) and got[2][0] == "graph_missing" and got[3][0] == "version_behind" and got[4][0] == "version_ahead"
    assert got[5][0] == "multi_version" and got[6][1] == "row_missing" and got[7][1] == "row_mismatch" and got[8] == (None, None, True)


def test_mutations_fold_in_order(spark):
    rows = [
        ("L", 1, 0, "add_node", 1, 0, [], "all"), ("L", 2, 1, "add_node", 2, 0, [], "all"), ("L", 2, 1, "add_edges", 2, 0, [1, 2], "all"),
        ("L", 3, 2, "add_node", 3, 0, [], "all"), ("L", 3, 2, "add_edges", 3, 0, [1, 2, 99], "base"),
        ("L", 4, 3, "add_node", 1, 0, [], "all"),  # minted anew: links to the old one are stale
        ("L", 5, 3, "add_edges", 2, 0, [1], "base"),  # means the old 1, which is gone
        ("L", 6, 5, "add_edges", 2, 0, [3], "base"),  # the edit drops the stale link
        ("R", 1, 0, "add_node", 7, 1, [], "all"), ("R", 2, 1, "add_node", 8, 0, [], "all"), ("R", 2, 1, "add_edges", 8, 0, [7], "all"), ("R", 3, 2, "remove_edges", 7, 0, [8], "base"),
    ]
    wal = spark.createDataFrame(rows, "eye string, seq_no long, as_of long, op string, base long, layer int, neighbors array<long>, side string")
    got = sorted((r.eye, r.src, r.dst, r.nbhd_seq) for r in graphs.apply_mutations(wal).collect())
    assert got == [("L", 2, 3, 6), ("L", 3, 1, 3), ("L", 3, 2, 3), ("R", 8, 7, 2)]


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (6, 1)], "src long, dst long")
    assert {r.serial: r.component for r in graphs.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [[rng.integers(0, 1 << 16, n) for n in (interchange.CODE_SIZE, interchange.MASK_SIZE) * 2] for _ in range(3)]
    data = b"".join(interchange.encode_record(k + 1, k, *p) for k, p in enumerate(parts))
    assert len(data) == 3 * interchange.RECORD == 3 * 76806
    (tmp_path / "chunk").write_bytes(data)
    got = sorted(interchange.read_snapshot(spark, str(tmp_path / "chunk")).collect())
    assert [(r.id, r.version) for r in got] == [(1, 0), (2, 1), (3, 2)]
    assert (np.frombuffer(got[2].right_code, np.uint16) == parts[2][2]).all()
    (tmp_path / "codes").write_text("\n".join(json.dumps({"iris_codes": f"c{k}", "mask_codes": f"m{k}"}) for k in range(5)) + "\n")
    assert [r.iris_codes for r in interchange.read_codes(spark, str(tmp_path / "codes"), "odd").orderBy("line").collect()] == ["c1", "c3"]
    assert [r.iris_codes for r in interchange.read_codes(spark, str(tmp_path / "codes"), limit=2).collect()] == ["c0", "c1"]
    interchange.write_int4(spark.createDataFrame([(b"\x1f" * 256,)], "packed binary"), str(tmp_path / "int4"))
    assert bytes(interchange.read_int4(spark, str(tmp_path / "int4")).first().packed) == b"\x1f" * 256


def test_index(spark):
    rows = [(k, (k * 2654435761) % (1 << 32), (1 << 32) - 1, 0) for k in range(1, 200)]
    index = Index(spark.createDataFrame(rows, "serial long, code long, mask long, version long"), SearchParams.from_json(SearchParams(m=4).to_json()))
    queries = spark.createDataFrame([(1, rows[5][1] ^ 1, (1 << 32) - 1), (2, 0, 0)], "req long, code long, mask long")
    assert [(r.req, r.serial, r.hd) for r in index.search(queries, 1).collect()] == [(1, 6, 1)]
    more = index.insert(spark.createDataFrame([(6, 0, 1), (500, 7, 7)], "serial long, code long, mask long"))
    assert {r.serial: r.version for r in more.codes.where("serial IN (6, 7, 500)").collect()} == {6: 1, 7: 0, 500: 0}
