"""Comparison by pairs of blocks: the same rows with blocks of any size and on odd tables, and no row of each pair."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  importing it registers the queries
from maskwell.functions import blocks
from maskwell.plans import hnsw
from maskwell.registry import QUERIES, SQL
from maskwell.sources import fixtures as X
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
NAMES = """
ann_recall argmin furthest insertion_list int4_dot_top1 layer_ideal luc_lookback min_rotation_fhd min_rotation_nhd mirror_attack partial_count_rule index_search knn_exact knn_truncated matched_rotations saturation reauth_rule fhd_pairs nhd_pairs dot_pairs match_or_policy distance_bundles one_eye_recheck prefilter_then_strict match_one_eye merged_results match_both_and topk_truncated_with_count identity_update_search
""".split()


def joined(node) -> int:
    """Rows that the joins of an executed plan have made."""
    kind = node.nodeName()
    if kind.startswith("AdaptiveSparkPlan"):
        return joined(node.executedPlan())
    if "QueryStage" in kind:
        return joined(node.plan())
    below = node.children()
    own = node.metrics().get("numOutputRows").get().value() if "Join" in kind or "Cartesian" in kind else 0
    return own + sum(joined(below.apply(k)) for k in range(below.size()))


@pytest.mark.parametrize("name", NAMES)
def test_joins_make_no_row_of_each_pair(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    assert joined(df._jdf.queryExecution().executedPlan()) < 10_000  # 22,500 pairs of two eyes


def test_first_batch_of_a_graph_makes_no_row_of_each_pair(spark):
    codes = X.database(hnsw.left_codes(spark, SF)).withColumn("layer", F.lit(0).cast("long"))
    near = hnsw.nearest_in_layers(codes, 0, 12)
    assert len(near.collect()) == 450 * 12
    assert joined(near._jdf.queryExecution().executedPlan()) < 10_000  # of 202,050 pairs


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Ids that come twice, rows without a vector, vectors without a bit that is clear of zero, equal vectors."""
    at = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(SF):
        if f != "embeddings.parquet":
            os.symlink(f"{SF}/{f}", f"{at}/{f}")
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 130")
    vector = "CASE WHEN vec_id % 31 = 5 THEN transform(embedding, x -> CAST(0 AS FLOAT)) WHEN vec_id % 37 = 3 THEN (SELECT first(embedding) FROM e WHERE vec_id = 1) ELSE embedding END AS embedding"
    e.createOrReplaceTempView("e")
    made = spark.sql(f"SELECT vec_id, {vector}, label FROM e")
    made.union(made.where("vec_id % 20 IN (0, 7)").selectExpr("vec_id", "transform(embedding, x -> -x)", "label")).coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(SQL)))
def test_small_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "ROWS", (7, 60))
    monkeypatch.setattr(blocks, "ROWS_OUT", (11, 90))
    monkeypatch.setattr(blocks, "BLOCKS", 4)
    assert difference(spark, name, SF, QUERIES, SQL) == ""


@pytest.mark.parametrize("name", ["min_rotation_fhd", "min_rotation_nhd", "matched_rotations", "distance_bundles", "fhd_pairs", "match_counters", "intra_batch_pairs", "int4_dot_top1"])
def test_odd_tables(spark, odd, monkeypatch, name):
    monkeypatch.setattr(blocks, "ROWS", (7, 60))
    monkeypatch.setattr(blocks, "ROWS_OUT", (7, 60))
    assert difference(spark, name, odd, QUERIES, SQL) == ""
