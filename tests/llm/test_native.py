"""Mixing and quality rules on edge cases; their SQL runs over whole tables."""

import pytest

import __spark_entry__ as entry
from maskwell.llm import mixing, quality_rules
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_quality_rules", "op9_mixing"])
def test_sql(spark, name):
    assert difference(spark, name, SF, entry.queries(), entry.oracle_sql()) == ""


def test_mixing_edges(spark):
    rows = [(1, "a b c", "s1", 9), (1, "a b c", "s1", 9), (2, None, "s1", 9), (3, "", None, 9), (4, "x " * 5000, None, 9), (None, "y y", "s2", 9), (5, "z", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 3, 3, 5000]
    # in order: "", s1, s2, null with weights 5, 2, 1, 5; all but null are capped at three times their size
    assert {r.source: r.target for r in got} == {"": 3.0, "s1": 18.0, "s2": 6.0, None: 5009.0 - 27}
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == 5009
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sorted(str(r.doc_id) for r in mixed.collect()) == sorted(["1"] * 6 + ["4"] + ["None"] * 3 + ["5"] * 3)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_quality_edges(spark):
    clean = " ".join(f"w{k}" for k in range(40))
    common = "this very line stands in a lot of texts of one host and is boilerplate for that reason"
    rows = [(k, f"{common}\n{clean} u{k}" if k % 2 else f"u{k}\n {common.upper()} \n{common}", "h", 1) for k in range(60)]
    rows += [(100, None, "h", 1), (101, "", None, 1), (102, "go " * 30000, "h", 1), (103, f"{common}\n{common} u", "other", 1), (103, f"{common}\n{common} u", "other", 1), (None, clean, None, 1)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[1].removed_words == 18 and not by[1].base_failed
    assert not by[2].kept and not by[2].base_failed and by[2].removed_words == 36
    assert by[100].n_words == 0 and by[100].base_failed and by[101].base_failed and by[102].n_repeat_words == 30000
    assert by[103].removed_words == 0 and by[None].kept
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
