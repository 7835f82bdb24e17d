"""Log replay against a sequential fold of the whole log of an eye."""

import random
from collections import Counter

from maskwell.operators import graphs

SCHEMA = "eye string, seq_no long, as_of long, op string, base long, layer int, neighbors array<long>, side string"


def fold(rows):
    import pandas as pd

    clock: dict[int, int] = {}
    lists: dict[tuple[int, int], list] = {}  # (layer, serial) -> [stamp, targets]

    def edit(layer, serial, seq, change):
        at = lists.get((layer, serial))
        if at is not None:
            kept = [z for z in at[1] if clock.get(z, at[0] + 1) <= at[0]]
            lists[layer, serial] = [seq, change(kept)]

    for seq, record in rows.groupby("seq_no", sort=True):
        as_of = int(record["as_of"].iloc[0])
        minted = set(record.loc[record["op"] == "add_node", "base"])
        fresh = lambda z: z in minted or clock.get(z, as_of + 1) <= as_of  # noqa: E731, B023
        edge_ops = []
        for r in record[record["op"].isin(["add_edges", "remove_edges"])].itertuples():
            if r.base in minted or r.base in clock:
                refs = [int(z) for z in r.neighbors if fresh(z) and (r.op == "remove_edges" or z != r.base)]
                if refs:
                    edge_ops.append((r.op, int(r.base), int(r.layer), refs, r.side))
        for r in record[record["op"].isin(["add_node", "remove_node"])].itertuples():
            base = int(r.base)
            if r.op == "remove_node":
                clock.pop(base, None)
                for key in [k for k in lists if k[1] == base]:
                    del lists[key]
            else:
                for layer in range(int(r.layer) + 1):
                    lists[layer, base] = [int(seq), []]
                clock[base] = int(seq)
        for op, base, layer, refs, side in edge_ops:
            add = op == "add_edges"
            if side in ("base", "all"):
                edit(layer, base, int(seq), lambda n: n + refs if add else [z for z in n if z not in refs])  # noqa: B023
            if side in ("neighbors", "all"):
                for z in refs:
                    edit(layer, z, int(seq), lambda n: [*n, base] if add else [x for x in n if x != base])  # noqa: B023
    out = [(rows["eye"].iloc[0], layer, src, z, stamp) for (layer, src), (stamp, to) in lists.items() for z in to]
    return pd.DataFrame(out, columns=["eye", "layer", "src", "dst", "nbhd_seq"])


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def sequential(wal):
    import pandas as pd

    frame = pd.DataFrame(wal, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return Counter(tuple(r) for _, part in frame.groupby("eye") for r in fold(part).itertuples(index=False))


def test_random_logs(spark):
    rng = random.Random(1)
    wal = []
    for k in range(150):  # logs of few nodes, so that they meet often
        nodes = rng.choice((3, 6, 12))
        for seq in range(1, 60):
            for _ in range(rng.choice((1, 1, 2, 4))):
                op = rng.choice(("add_node", "add_node", "add_edges", "add_edges", "add_edges", "remove_edges", "remove_node"))
                wal.append((f"e{k}", seq, seq - rng.choice((1, 1, 2, 9)), op, rng.randrange(nodes), rng.choice((0, 0, 1)), [rng.randrange(nodes + 1) for _ in range(rng.randrange(4))], rng.choice(("base", "neighbors", "all"))))
    first = {}
    wal = [(e, seq, first.setdefault((e, seq), a), *rest) for e, seq, a, *rest in wal]  # a record has one as_of
    got = rows(graphs.apply_mutations(spark.createDataFrame(wal, SCHEMA)))
    assert got == sequential(wal)
    assert len(got) > 300


def test_all_events_are_replayed(spark):
    folder = "/root/testdata/sf0.001"
    wal = []
    for k in range(1000):
        seq, base = k + 1, k % 200
        ops = ["remove_node"] if seq % 17 == 0 else ["remove_edges"] if seq % 11 == 0 else ["add_node", "add_edges"]
        wal += [(eye, seq, seq - 1, op, base, 0, [(base - j) % 200 for j in range(1, 5)], "all") for eye in "LR" for op in ops]
    assert rows(graphs.wal_apply(spark, folder)) == sequential(wal)


def test_nodes_fold_in_one_pass(spark):
    plan = graphs.wal_apply(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan


def test_long_lists_lose_stale_links():
    rng = random.Random(2)
    for _ in range(20):
        held, plain, seq = graphs.Neighbours(0), [], 0
        for _ in range(400):
            seq += rng.choice((0, 1, 1, 3))
            nodes = [rng.randrange(30) for _ in range(rng.randrange(1, 6))]
            stales, remove = [seq + rng.choice((0, 1, 5, 50, 1 << 62)) for _ in nodes], rng.random() < 0.1
            held.edit(seq, remove, nodes, stales)
            plain = [x for x in plain if x[1] > seq]
            plain = [x for x in plain if x[0] not in nodes] if remove else plain + list(zip(nodes, stales))
            assert held.stamp == seq
        assert Counter(held.targets()) == Counter(z for z, _ in plain)
