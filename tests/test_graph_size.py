"""Graph queries over more ids than their SQL states, against plain Python."""

from collections import Counter

import pytest

from maskwell.operators import graphs

N = 2300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    spark.range(N).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{at}/customer.parquet")
    spark.range(901, 3500).selectExpr("id AS event_id").write.parquet(f"{at}/events.parquet")
    return at


def brute():
    nodes = [(layer, s) for layer, step in enumerate((1, 8, 64)) for s in range(0, N, step)]
    edges = [(layer, s, (s // 8**layer * 31 + j * 17) % ((N + 40) // 8**layer) * 8**layer + 8**layer) for layer, s in nodes if s % 50 != 7 for j in range(1, 7)]
    return nodes, edges


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_nodes_and_edges(spark, folder):
    nodes, edges = brute()
    assert rows(graphs.nodes(spark, folder).select("layer", "serial")) == Counter(nodes)
    assert rows(graphs.edges(spark, folder).select("layer", "src", "dst")) == Counter(edges)
    assert {dst for layer, _, dst in edges if layer == 0} - {s for _, s in nodes}  # some targets are missing


def test_queries_follow_the_table(spark, folder):
    nodes, edges = brute()
    held = set(nodes)
    live = [e for e in edges if (e[0], e[2]) in held and e[2] * 7 % 1000 <= e[1] * 7 % 1000 + 300]
    assert rows(graphs.active_links(spark, folder).select("layer", "src", "dst")) == Counter(live)
    assert rows(graphs.check_1b(spark, folder)) == Counter((s, "excluded_but_present") for s in range(N - 10, N))
    mark, left, right = (max(s for s in range(N) if s % m != r) for m, r in ((50, 49), (40, 1), (40, (N - 1) % 40)))
    assert graphs.check_2(spark, folder).first().asDict() == {"mark": mark, "max_id": N - 1, "left_max": left, "right_max": right, "mark_ok": mark == N - 1, "eyes_equal": left == right}
    twice = Counter(edges + [e for e in edges if e[1] % 70 == 3])
    assert rows(graphs.check_1f(spark, folder)) == Counter((*e, n) for e, n in twice.items() if n > 1)
    degree = Counter()
    for (layer, src, _), n in twice.items():
        degree[layer, src] += n
    assert rows(graphs.check_1g(spark, folder)) == Counter((*k, n) for k, n in degree.items() if n > (8 if k[0] == 0 else 6))
    changed = {k % N for k in range(901, 3500)}
    probe = Counter((layer, dst) for layer, src, dst in edges if src in changed)
    assert rows(graphs.recency_probe(spark, folder)) == Counter((*k, n) for k, n in probe.items())
    to = {}
    for layer, src, dst in edges:
        if layer == 0 and dst <= N:
            to.setdefault(src, set()).add(dst)
    hop, front = {64: 0}, {64}
    while front:
        step = max(hop.values()) + 1
        front = {d for s in front for d in to.get(s, ())} - set(hop)
        hop |= dict.fromkeys(front, step)
    assert rows(graphs.bfs_hops(spark, folder)) == Counter(hop.items())
