"""Graph queries over more ids than their SQL states: the SQL with its range of ids as wide as the table has the same rows."""

import re

import pytest

import __spark_entry__  # noqa: F401  importing it registers the queries
from maskwell.operators.graphs import LEAST_IDS, id_range
from maskwell.registry import QUERIES, SQL
from tests.oracle import difference

SF = "/root/testdata/sf0.1"
NAMES = "active_links bfs_hops bucket_matrix check_1a_orphans check_1b_coverage check_1c_layers check_1d_neighbours check_1e_self_loops check_1f_duplicates check_1g_degree check_1h_entry_points check_1i_same_ids check_1j_layer_sizes check_2_watermarks".split()


def widened(sql: str, n: int) -> str:
    """Literals from 1,490 to 1,550 follow the range; 1536 is an entry point. Hops end where the query's do."""
    return re.sub(r"\b1(?:490|500|540|545|550)\b", lambda m: str(int(m[0]) - LEAST_IDS + n), sql).replace("hop < 12", "hop < 50")


@pytest.mark.parametrize("name", NAMES)
def test_only_the_range_differs(spark, name):
    n = id_range(spark, SF)
    assert n > LEAST_IDS
    assert difference(spark, name, SF, QUERIES, SQL | {name: widened(SQL[name], n)}) == ""
