"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps over tables of runs.

Sizes are whole numbers up to the capacity, so pieces of a size are interchangeable, and so are gaps. Both sides are
kept as run tables, a row for many pieces of a size or for many consecutive sequences with a gap of a size. Their rows
are bounded by the capacity, whatever the number of documents. A round:

1. sequences are opened for pieces beyond the widest gap, as many as their tokens need at least (one for each piece of
   over half the capacity);
2. pieces and gaps are range-sorted together by size, and every range is swept at once: pieces wait on a stack, and a
   gap, coming after all that fit it, takes from the top the largest that waits. So a piece meets its successor, the
   smallest gap that holds it and that no larger piece has a claim to: rank on the stack resolves conflicts;
3. gaps are updated and staged with the pieces left over, and the next round begins.

A round deals with pieces of over half the size of the largest one left, so that small ones do not take the room of
larger ones. Tests hold the number of sequences against sequential best-fit decreasing.

The pieces themselves are range-sorted by size over all tasks; each task numbers its own, the counts of the tasks give
every piece its rank in its run, and a search for the slot of a rank places it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_slices, stage, table, text_of
from .tokens import WORD_BPE, Coder, tokenizer_path

CAPACITY = 2048


#: Rows of the run tables that a task sweeps; more rows make more ranges.
ROWS_A_RANGE = 1 << 16
PIECE, GAP, SLOT = 0, 1, 2
STATE = "kind int, size bigint, first bigint, number bigint, sequence bigint, each bigint, offset bigint"


def swept(least: int, capacity: int):
    """One sweep over a range of ``STATE`` rows that ascend by size, pieces before gaps: what is left, and slots.

    A piece row has the first rank and the number of pieces, a gap row the first sequence and the number of sequences. A
    slot says that ranks from the first one on go to consecutive sequences, ``each`` in one, the first at the offset.
    Pieces of less than ``least`` stay.
    """

    def run(batches):
        import pyarrow as pa

        names, waiting, out = [x.split()[0] for x in STATE.split(", ")], [], []

        def gap(size: int, sequence: int, number: int) -> None:
            if size and number:
                out.append((GAP, size, sequence, number, 0, 0, 0))

        for b in batches:
            for kind, size, first, number in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == PIECE:
                    if size < least:
                        out.append((PIECE, size, first, number, 0, 0, 0))
                    else:
                        waiting.append((size, first, number))
                    continue
                while number and waiting:
                    piece, rank, n = waiting.pop()
                    each = size // piece
                    full = min(number, n // each)
                    for sequences, inside in ((full, each), (int(n < each * number and n % each > 0), n % each)):
                        if sequences:
                            out.append((SLOT, piece, rank, sequences * inside, first, inside, capacity - size))
                            gap(size - inside * piece, first, sequences)
                            rank, n, first, number = rank + sequences * inside, n - sequences * inside, first + sequences, number - sequences
                    if n:
                        waiting.append((piece, rank, n))
                gap(size, first, number)
        out += [(PIECE, *x, 0, 0, 0) for x in waiting]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 0 else pa.int64()) for k in range(len(names))], names=names)

    return run


def best_fit_rounds(runs: DataFrame, capacity: int = CAPACITY, rows_a_range: int = ROWS_A_RANGE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (size, first rank, pieces, first sequence, pieces in a sequence, offset) for ``runs(size, number)``.

    Each size must lie between 1 and the capacity. Rounds of sweeps go on until no piece is left; each writes its tables
    into the shared folder. Only totals and the slots come to the driver; like the runs, these are bounded by the capacity.
    """
    spark, zero = runs.sparkSession, F.lit(0).cast("long")
    state = stage(runs.select(F.lit(PIECE).alias("kind"), "size", zero.alias("first"), "number", zero.alias("sequence"), zero.alias("each"), zero.alias("offset")).coalesce(1), "runs")
    slots, opened, most = [], 0, None
    while True:
        widest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("size")))
        all_ = state.agg(widest(PIECE).alias("piece"), widest(GAP).alias("gap"), F.count(F.lit(1)).alias("rows")).first()
        if all_.piece is None:
            return slots
        least = all_.piece // 2 + 1
        if all_.piece > (all_.gap or 0):
            beyond = state.where((F.col("kind") == PIECE) & (F.col("size") > max(all_.gap or 0, least - 1)))
            need = beyond.agg(F.sum(F.when(2 * F.col("size") > capacity, F.col("number"))).alias("alone"), F.sum(F.col("size") * F.col("number")).alias("tokens")).first()
            new = need.alone or -(-need.tokens // capacity)
            values = [GAP, capacity, opened, new, 0, 0, 0]
            state = state.union(spark.range(0, 1, 1, 1).select(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(values, STATE.split(", "), strict=True)]))
            opened += new
        ranges = max(1, min(-(-all_.rows // rows_a_range), most or all_.rows))
        ranged = state.repartitionByRange(ranges, "size") if ranges > 1 else state.coalesce(1)
        done = stage(ranged.sortWithinPartitions("size", "kind", "first").mapInArrow(swept(least, capacity), STATE), "sweep")
        found = done.where(F.col("kind") == SLOT).select("size", "first", "number", "sequence", "each", "offset").collect()
        slots += [tuple(r) for r in found]
        # a range without a match keeps its pieces; where no range has one, the next sweep takes wider ranges
        most = None if found else max(1, ranges // 2)
        state = done.where(F.col("kind") != SLOT)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (long): their place in sequences of at most ``capacity``.

    ``length`` must lie between 1 and the capacity; null or other lengths raise an error. ``order`` breaks ties between
    pieces of a length; rows that agree in it are interchangeable, so repeated rows each get a place of their own. An
    empty table gives no rows. All columns stay, except that ones named ``sequence_id`` and ``offset`` are replaced.
    """
    order = order if order is not None else [c for c in pieces.columns if c != length]
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    plain = stage(pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{length}`").cast("long").alias("length"), *[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)]), "pieces")
    counts = {r.length: r.n for r in plain.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    by = ["length", *[f"o{k}" for k in range(len(order))]]
    row = StructType([plain.schema["row"]])
    dealt = stage(plain.repartitionByRange(*by).sortWithinPartitions(*by).select("row", "length").mapInArrow(numbered(), StructType([*row, *StructType.fromDDL("length bigint, part int, at bigint")])), "sorted")
    parts = {r.part: (r.n, r.low) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("low")).collect()}  # a row a task
    starts, total = {}, 0
    for part in sorted(parts):
        starts[part], total = total, total + parts[part][0]
    runs, before = {}, 0
    for size in sorted(counts):
        runs[size], before = before, before + counts[size]
    slots = sorted(best_fit_rounds(plain.groupBy(F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("number")), capacity))
    shared = dealt.sparkSession.sparkContext.broadcast((starts, runs, slots))
    return dealt.mapInArrow(placed(shared), StructType([*row, *StructType.fromDDL("sequence_id bigint, offset bigint")])).select("row.*", "sequence_id", "offset")


def numbered():
    """Number the rows of a task in the order in which they come."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=["row", "length", "part", "at"])
            at += n

    return run


def placed(shared):
    """Find the slot of each piece: the last one that begins at or before its size and rank."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        starts, runs, slots = shared.value
        table = np.array(slots, np.int64).reshape(-1, 6)
        # sizes and ranks together ascend, so that one search over global ranks does
        begins = np.array([runs[s] for s in table[:, 0].tolist()], np.int64) + table[:, 1]
        for b in batches:
            part, at = b.column(2).to_numpy(), b.column(3).to_numpy()
            rank = np.array([starts[p] for p in part.tolist()], np.int64) + at
            k = np.searchsorted(begins, rank, "right") - 1
            size, _, _, first, each, offset = table[k].T
            inside = rank - begins[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first + inside // each), pa.array(offset + inside % each * size)], names=["row", "sequence_id", "offset"])

    return run


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The ids of each text, then ``end_id``, cut into pieces of ``capacity`` where there are more: ``PIECES``.

    Null and empty texts are one piece with the end id alone. Repeated rows give repeated pieces.
    """

    def run(rows: dict) -> dict:
        import zlib
        from array import array

        coder, end = Coder.at(path or tokenizer_path(WORD_BPE)), array("I", [end_id]).tobytes()
        out: dict = {x.split()[0]: [] for x in PIECES.split(", ")}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            ids = coder.ids(text) + end
            for k in range(0, len(ids), 4 * capacity):
                piece = ids[k : k + 4 * capacity]
                row = (doc_id, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return out

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), run, PIECES)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` with the place of each piece; see ``pack`` and ``token_pieces`` for the defined cases."""
    return pack(token_pieces(docs, path, capacity), capacity, "length", ["doc_id", "piece"])


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
