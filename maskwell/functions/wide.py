"""Full 12,800-bit codes as binary columns of 1,600 bytes, compared in Arrow batches.

A database row meets a bounded, broadcast batch of queries, each in all its rotations, in one vectorised pass; so the
database is read once, is never rotated, and no pair is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distance as D

# No distance, and how many queries a pass takes at most (31 rotations of 3,200 bytes each: 100 KB a query).
NONE, PASS_QUERIES = 65535, 512


def mirror_order():
    """For each bit of a mirrored code, the bit that it comes from.

    Bits stand as (row, column, wavelet, part) in 16 x 200 x 2 x 2; the mirror reverses the columns of each half.
    """
    import numpy as np

    at = np.arange(D.CODE_BITS).reshape(16, 200, 2, 2)
    return np.concatenate([at[:, 99::-1], at[:, :99:-1]], axis=1).reshape(-1)


def mirrored(code, mask):
    """The mirror of a code and its mask: columns reversed in each half, and every imaginary bit of the code flipped."""
    order = mirror_order()
    return code[order] ^ (order % 2).astype(code.dtype), mask[order]


def storage_order():
    """The place of each bit in the order of shares: part, wavelet, row mod 4, column, row div 4."""
    import numpy as np

    return np.arange(D.CODE_BITS).reshape(4, 4, 200, 2, 2).transpose(4, 3, 1, 2, 0).reshape(-1)


def get_bit(code: bytes, k: int) -> int:
    return code[k // 8] >> (7 - k % 8) & 1


def with_bit(code: bytes, k: int, on: bool | None = None) -> bytes:
    """``code`` with a bit set, cleared, or flipped if ``on`` is None."""
    out, bit = bytearray(code), 1 << (7 - k % 8)
    out[k // 8] = out[k // 8] ^ bit if on is None else out[k // 8] | bit if on else out[k // 8] & ~bit
    return bytes(out)


def graded(code, mask, k: int, seed: int = 0):
    """``code`` with ``k`` of its visible bits flipped, chosen by a seed."""
    import numpy as np

    seen = np.flatnonzero(mask)
    out = code.copy()
    out[np.random.default_rng(seed).choice(seen, min(k, len(seen)), replace=False)] ^= 1
    return out


def noisy(code, mask, code_p: float, mask_p: float, seed: int = 0):
    """Bits of the code flip with a probability; bits of the mask flip in pairs, real and imaginary together."""
    import numpy as np

    rng = np.random.default_rng(seed)
    pairs = np.repeat(rng.random(len(mask) // 2) < mask_p, 2)
    return code ^ (rng.random(len(code)) < code_p).astype(code.dtype), mask ^ pairs.astype(mask.dtype)


def noisy_nibbles(values, p: float, seed: int = 0):
    """Signed four-bit numbers that move by one, up or down, with a probability, and stay within -8 and 7."""
    import numpy as np

    rng = np.random.default_rng(seed)
    step = np.where(rng.random(len(values)) < p, rng.choice([-1, 1], len(values)), 0)
    return np.clip(np.asarray(values, np.int64) + step, -8, 7).astype(np.int8)


def least_distances(db: DataFrame, queries: DataFrame, rotations: int = 31, normalised: bool = False) -> DataFrame:
    """``req, serial, hd, md``: the least distance over centred rotations of each query to each row of ``db``.

    ``db`` has ``serial, code, mask``, ``queries`` ``req, code, mask``; one rotation is the simple mode. The first rotation
    wins a tie, and pairs whose masks never meet have ``NONE`` twice. Null codes are left out. Queries go in passes of at
    most ``PASS_QUERIES``, so what is broadcast is bounded; more passes read the database again.
    """
    batch = queries.where("code IS NOT NULL AND mask IS NOT NULL").select("req", "code", "mask").orderBy("req")
    rows = batch.toLocalIterator(prefetchPartitions=True)
    out, held = None, []

    def one_pass(held: list) -> DataFrame:
        shared = db.sparkSession.sparkContext.broadcast(turned(held, rotations))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            reqs, codes, masks = shared.value  # codes and masks: query, rotation, 200 words
            for b in batches:
                for serial, code, mask in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                    both = masks & np.frombuffer(mask, np.uint64)
                    md = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
                    hd = np.bitwise_count((codes ^ np.frombuffer(code, np.uint64)) & both).sum(axis=2, dtype=np.int64)
                    top = md * (20 * hd - 9 * md) + 147456 * hd if normalised else hd
                    with np.errstate(divide="ignore", invalid="ignore"):
                        best = np.where(md > 0, top / md, np.inf).argmin(axis=1)
                    at = np.arange(len(reqs))
                    some = md[at, best] > 0
                    yield pa.RecordBatch.from_arrays([pa.array(reqs), pa.array(np.full(len(reqs), serial)), pa.array(np.where(some, hd[at, best], NONE)), pa.array(np.where(some, md[at, best], NONE))], names=["req", "serial", "hd", "md"])

        return db.where("code IS NOT NULL AND mask IS NOT NULL").select(F.col("serial").cast("long").alias("serial"), "code", "mask").mapInArrow(run, "req bigint, serial bigint, hd bigint, md bigint")

    for row in rows:
        held.append(row)
        if len(held) == PASS_QUERIES:
            out, held = one_pass(held) if out is None else out.union(one_pass(held)), []
    return one_pass(held) if out is None else out.union(one_pass(held)) if held else out


def turned(rows: list, rotations: int):
    """Ids of queries, and their codes and masks in all rotations as 64-bit words."""
    import numpy as np

    reqs = np.array([r["req"] for r in rows], np.int64)
    words = lambda name: np.array([[np.packbits(D.rotate(np.unpackbits(np.frombuffer(r[name], np.uint8)), by)).view(np.uint64) for by in range(-(rotations // 2), rotations // 2 + 1)] for r in rows], np.uint64).reshape(len(rows), rotations, -1)
    return reqs, words("code"), words("mask")
