import random
import zlib
from array import array
from collections import defaultdict

import pytest

from maskwell.llm import packing, tokens


def sequential(sizes, capacity):
    """Best-fit decreasing, one piece at a time: the number of sequences and their sorted gaps."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= size]
        if fit:
            k = min(fit, key=lambda k: gaps[k])
            gaps[k] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps), sorted(gaps)


def runs_of(spark, sizes):
    return spark.createDataFrame([(s, sizes.count(s)) for s in sorted(set(sizes))], "size long, number long")


@pytest.mark.parametrize("capacity, rows_a_range", [(1, 1 << 16), (20, 1 << 16), (64, 1 << 16), (64, 8), (97, 3)])
def test_rounds_place_every_piece_as_tightly_as_sequential_best_fit(spark, capacity, rows_a_range):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(400)]
    used, ranks = defaultdict(dict), defaultdict(list)
    for size, rank, n, first, each, offset in packing.best_fit_rounds(runs_of(spark, sizes), capacity, rows_a_range):
        for r in range(n):
            ranks[size].append(rank + r)
            assert used[first + r // each].setdefault(offset + r % each * size, size) == size
    assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(sizes.count(s))) for s in set(sizes)}
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts.items()):
            assert offset == at
            at += size
        assert at <= capacity
    assert sum(len(p) for p in used.values()) == len(sizes) and set(used) == set(range(len(used)))
    assert len(used) <= 1.01 * sequential(sizes, capacity)[0] + 1


def test_small_pieces_and_one_size(spark):
    for sizes in ([3] * 100, [1] * 50, [20], [11] * 7 + [9] * 7):
        slots = packing.best_fit_rounds(runs_of(spark, sizes), 20)
        assert max(first - (-n // each) for _, _, n, first, each, _ in slots) == sequential(sizes, 20)[0]
    assert packing.best_fit_rounds(runs_of(spark, [20]).limit(0), 20) == []


def test_sweep_gives_a_gap_to_the_largest_piece_that_fits():
    import pyarrow as pa

    rows = [(0, 3, 0, 2), (0, 5, 0, 1), (1, 6, 7, 2), (0, 8, 0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["kind", "size", "first", "number"])
    out = [tuple(r.values()) for b in packing.swept(1, 10)(iter([batch])) for r in b.to_pylist()]
    assert [r for r in out if r[0] == packing.SLOT] == [(2, 5, 0, 1, 7, 1, 4), (2, 3, 0, 2, 8, 2, 4)]
    assert [r[:4] for r in out if r[0] != packing.SLOT] == [(1, 1, 7, 1), (0, 8, 0, 1)]


def test_pack_bad_lengths(spark):
    for bad in (0, 2049, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"))


def check(rows, texts, capacity):
    coder = tokens.Coder.at(tokens.tokenizer_path(tokens.WORD_BPE))
    want = []
    for k, t in texts:
        ids = [*coder.library_ids(t or ""), 0]
        want += [(k, j, s, len(ids[s : s + capacity]), zlib.crc32(array("I", ids[s : s + capacity]).tobytes())) for j, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == sequential([r.length for r in rows], capacity)[0]


def test_documents(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice(["alpha", "beta", "x1y2"]) for _ in range(rng.randrange(200)))) for k in range(150)]
    texts += [(900, None), (901, ""), (902, "word " * 9000), (903, "same"), (903, "same"), (904, "same")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, offset int").repartition(5)
    check(packing.packed_documents(docs).collect(), texts, 2048)
    check(packing.packed_documents(docs, capacity=100).collect(), texts, 100)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(packing.op1_best_fit_packing(spark, sf).collect(), texts, 2048)
