"""Pairs of masked codes by blocks: the work of a theta join in numpy, one block of either side at a time.

Both sides are dealt to blocks of bounded size, each packed into one value. Every pair of blocks is a row, these rows are
dealt to tasks one by one, and a kernel makes of each what a query needs: the nearest, counts, or the pairs that match.
So a task holds two blocks and one strip of distances, no row of a pair is made that the query doesn't return or reduce,
and nothing depends on how many files or partitions a table has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a block of requests and of the database; smaller ones where most pairs are returned.
ROWS, ROWS_OUT = (2048, 32768), (512, 8192)
#: Positions in a block take 16 bits of a key.
PLACES = 1 << 16
#: Blocks of requests that are broadcast; more are joined by exchange.
BLOCKS = 512
#: Pairs in a strip of distances, and the places beside each other in it where every pair is returned.
STRIP, BESIDE = 1 << 18, 512
WIDTH = 65  # numbers of bits, 0 to 64


def packed(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """``df``, whose first column is an id, as blocks ``name, name_no`` in order of ids, and the number of blocks.

    A column ``code<x>`` stands beside ``mask<x>``; a missing code has an empty mask.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    key, *rest = df.columns
    of = lambda c: F.when(F.col(f"code{c[4:]}").isNull(), 0).otherwise(F.coalesce(c, F.lit(0))) if c.startswith("mask") else F.coalesce(c, F.lit(0)) if c.startswith("code") else F.col(c)
    df = df.select(F.col(key).cast("long").alias("id"), *[of(c).cast("long").alias(c) if c[:4] in ("code", "mask") else F.col(c) for c in rest])
    blocks, empty = max(1, -(-df.count() // rows)), to_arrow_schema(df.schema).empty_table()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        table = (pa.Table.from_batches(batches) if batches else empty).sort_by("id").combine_chunks()
        for k, c in enumerate(table.column_names):
            if c[:4] in ("code", "mask"):
                x = table.column(c).to_numpy().view(np.uint64)
                table = table.set_column(k, c, pa.array(x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x))
        for at in range(0, max(1, table.num_rows), PLACES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(at, PLACES))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([TaskContext.get().partitionId()], pa.int32())], names=[name, f"{name}_no"])

    return df.repartition(blocks).mapInArrow(pack, f"{name} binary, {name}_no int"), blocks


def compared(q: DataFrame, d: DataFrame, kernel: Callable[[dict, dict], Iterator[list]], schema: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """What ``kernel`` makes of every pair of blocks; it gets the columns of both and yields columns of ``schema``.

    The first column of a side is its id and called ``id`` in the kernel.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..sources.fixtures import cut

    rows = rows or ROWS
    (left, n), (right, m) = packed(q, rows[0], "q"), packed(d, rows[1], "d")
    left, right = (F.broadcast(left), right) if n <= BLOCKS else (cut(left), cut(right))
    out = to_arrow_schema(StructType.fromDDL(schema))
    tasks = n * m if n * m <= 64 else max(64, -(-n * m // 4))
    place = (F.col("d_no").cast("long") * n + F.col("q_no")) % tasks

    def run(batches):
        import pyarrow as pa

        def opened(value) -> dict:
            table = pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()
            return {c: x.to_numpy() if pa.types.is_integer(x.type) else x.combine_chunks() for c, x in zip(table.column_names, table.columns)}

        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                for columns in kernel(opened(left), opened(right)):
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)

    return right.crossJoin(left).repartitionById(tasks, place.cast("int")).select("q", "d").mapInArrow(run, schema)


def unique(df: DataFrame, key: str) -> bool:
    """Whether no id comes twice, so that pairs need no grouping."""
    return df.groupBy(key).count().where("count > 1").isEmpty()


def strips(q: dict, d: dict) -> Iterator[slice]:
    """The requests in runs that make one strip of distances with the whole block ``d``."""
    step = max(1, STRIP // max(1, len(d["id"])))
    return (slice(k, min(k + step, len(q["id"]))) for k in range(0, len(q["id"]), step))


class Side:
    """Differing and comparable bits of some requests (rows) and some of the database (columns)."""

    def __init__(self, q: dict, d: dict, at: slice, beside: slice = slice(None), q_end: str = "", d_end: str = ""):
        import numpy as np

        both = q[f"mask{q_end}"][at, None] & d[f"mask{d_end}"][beside]
        self.hd = np.bitwise_count((q[f"code{q_end}"][at, None] ^ d[f"code{d_end}"][beside]) & both)
        self.md = np.bitwise_count(both)

    def close(self, threshold: float):
        """Strictly below the threshold; false for an empty mask."""
        return self.hd < limits(threshold).take(self.md)

    def of(self, table):
        """The entries of a table of ``WIDTH * WIDTH`` distances."""
        return table.take(self.place(), mode="clip")

    def place(self):
        import numpy as np

        return self.md.astype(np.uint16) * WIDTH + self.hd


def memo(function):
    """Tables are made once a worker; they are functions of constants."""
    made: dict = {}

    def get(*key):
        if key not in made:
            made[key] = function(*key)
        return made[key]

    return get


@memo
def limits(threshold: float):
    """For each number of comparable bits, from how many differing ones on a pair isn't close."""
    import numpy as np

    hd, md = np.arange(WIDTH, dtype=float), np.arange(WIDTH, dtype=float)
    return ((hd[None, :] < md[:, None] * threshold) & (md[:, None] > 0)).sum(axis=1).astype(np.uint8)


@memo
def values(order: str):
    """Distances by ``md * WIDTH + hd``; nan for an empty mask."""
    import numpy as np

    md, hd = np.divmod(np.arange(WIDTH * WIDTH), WIDTH)
    top = hd if order == "fhd" else md * (20 * hd - 9 * md) + 147456 * hd
    return np.where(md > 0, top / np.maximum(md, 1).astype(float), np.nan)


@memo
def ranks(order: str, down: bool = False):
    """The place of each distance among all there are; ``NONE`` for an empty mask."""
    import numpy as np

    md, hd = np.divmod(np.arange(WIDTH * WIDTH), WIDTH)
    real = (md > 0) & (hd <= md)
    found, place = np.unique(values(order)[real], return_inverse=True)
    out = np.full(WIDTH * WIDTH, NONE, np.uint16)
    out[real] = len(found) - 1 - place if down else place
    return out


NONE = 0xFFFF


def nearest(k: int, order: str = "fhd", itself: bool = True, down: bool = False, bands: list[list[int]] | None = None):
    """Kernel: ``NEAREST`` columns of the ``k`` nearest (with ``down`` the furthest) of each request, ties by id.

    Unless ``itself``, a row of the same id is no hit. With ``bands``, lists of bit positions, only rows that agree with
    the request in one of them are looked at.
    """
    import numpy as np

    def kernel(q, d):
        here, table = np.arange(len(d["id"]), dtype=np.uint32), ranks(order, down).astype(np.uint32) << 16
        none, parts = np.uint32(NONE << 16), []
        share = sharing(q, d, bands) if bands and len(here) else None
        for at in strips(q, d) if len(here) else ():
            side = Side(q, d, at)
            key = side.of(table) | here
            for r, req in enumerate(q["id"][at]) if not itself or share else ():
                if not itself:
                    key[r, np.searchsorted(d["id"], req) : np.searchsorted(d["id"], req, "right")] = none
                if share:
                    key[r][~share(at.start + r)] = none
            best = key.min(axis=1, keepdims=True) if k == 1 else np.partition(key, k - 1, axis=1)[:, :k] if len(here) > k else key
            r, c = np.nonzero(best < none)
            place = (best[r, c] & 0xFFFF).astype(np.int64)
            parts.append((q["id"][at][r], d["id"][place], side.hd[r, place], side.md[r, place], side.place()[r, place]))
        if parts:
            req, serial, hd, md, state = (np.concatenate(x) for x in zip(*parts))
            yield [req, serial, hd, md, values(order)[state]]

    return kernel


NEAREST = "req bigint, serial bigint, hd bigint, md bigint, dist double"


def sharing(q: dict, d: dict, bands: list[list[int]]):
    """A function of a request's place: which rows of ``d`` agree with it in a band. Rows are sorted by each band once."""
    import numpy as np

    def band(x, at):
        return sum(((x >> p) & 1).astype(np.int64) << j for j, p in enumerate(at))

    sorted_by = []
    for at in bands:
        own = band(d["code"], at)
        sorted_by.append((np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange((1 << len(at)) + 1)), band(q["code"], at)))

    def share(k: int):
        out = np.zeros(len(d["id"]), bool)
        for rows, starts, asked in sorted_by:
            out[rows[starts[asked[k]] : starts[asked[k] + 1]]] = True
        return out

    return share


def top(found: DataFrame, k: int, down: bool = False) -> DataFrame:
    """The ``k`` nearest of each request over all blocks, with their ``rank``."""
    from pyspark.sql import Window

    order = F.desc("dist") if down else F.asc("dist")
    rank = F.row_number().over(Window.partitionBy("req").orderBy(order, "serial"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def k_nearest(q: DataFrame, d: DataFrame, k: int, order: str = "fhd", itself: bool = True, down: bool = False, bands=None) -> DataFrame:
    """``NEAREST, rank``: the exact ``k`` nearest rows ``d(serial, code, mask)`` of each of ``q(req, code, mask)``."""
    return top(compared(q.select("req", "code", "mask"), d.select("serial", "code", "mask"), nearest(k, order, itself, down, bands), NEAREST), k, down)


def counts(conditions: Callable[[dict, dict, slice], list], some: bool = False):
    """Kernel: a row a request with the number of rows that hold each condition; with ``some`` none without a row to count."""

    def kernel(q, d):
        import numpy as np

        parts = [[np.count_nonzero(c, axis=1) for c in conditions(q, d, at)] for at in strips(q, d)]
        if parts and (len(d["id"]) or not some):
            yield [q["id"], *[np.concatenate(x) for x in zip(*parts)]]

    return kernel


def matches(keep: Callable[[dict, dict, slice], tuple]):
    """Kernel: ``req, serial`` and the columns that ``keep`` gives beside the mask of the pairs to return."""

    def kernel(q, d):
        import numpy as np

        for at in strips(q, d) if len(d["id"]) else ():
            mask, *columns = keep(q, d, at)
            hit = np.flatnonzero(mask)
            for k in range(0, len(hit), STRIP // 4):
                part = hit[k : k + STRIP // 4]
                r, c = np.divmod(part, len(d["id"]))
                yield [q["id"][at][r], d["id"][c], *[x.ravel()[part] if isinstance(x, np.ndarray) else x(part) for x in columns]]

    return kernel


def every(make: Callable[[dict, dict, slice, slice], Iterator[list]]):
    """Kernel for what returns nearly all pairs. Few places stand beside each other, so that ids repeat within a page of the output."""

    def kernel(q, d):
        import numpy as np

        for lo in range(0, len(d["id"]), BESIDE):
            beside = slice(lo, min(lo + BESIDE, len(d["id"])))
            for first in range(0, len(q["id"]), 64):
                at = slice(first, min(first + 64, len(q["id"])))
                req, serial = np.repeat(q["id"][at], beside.stop - lo), np.tile(d["id"][beside], at.stop - first)
                for hit, *columns in make(q, d, at, beside):
                    yield [req, serial, *columns] if hit is None else [req[hit], serial[hit], *columns]

    return kernel


def said(eye: str, n: int):
    import pyarrow as pa

    return pa.repeat(pa.scalar(eye), n)


def rotated(x, by: int):
    """32 bits, rotated left."""
    import numpy as np

    n, x = by % 32, x.astype(np.uint64)
    return ((x << np.uint64(n) | x >> np.uint64(32 - n)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def rotations(q: dict, reach: int, ends: tuple[str, ...]) -> list[dict]:
    """The requests' codes ``code<end>, mask<end>`` in each rotation from ``-reach`` to ``reach``."""
    return [{"id": q["id"]} | {f"{c}{e}": rotated(q[f"{c}{e}"], by) for c in ("code", "mask") for e in ends} for by in range(-reach, reach + 1)]


def lists(mask, values):
    """Arrow lists: of each row of ``mask`` the values that it marks."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(np.count_nonzero(mask, axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[mask]))
