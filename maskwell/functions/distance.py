"""Distances between masked bit codes and small-integer vectors, as column expressions and, for full codes, in numpy.

A distance is a pair (hd, md): differing and comparable bits. Fractions order like exact cross multiplication, as pairs
of at most 12,800 bits differ by far more than a double's spacing. An empty mask has no distance (null) and never wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strict and the loose match threshold, and the shape of a full code.
STRICT, LOOSE = 0.345, 0.375
COLUMNS, BLOCK, CODE_BITS = 200, 800, 12800


def hd_md(code_a: Column, mask_a: Column, code_b: Column, mask_b: Column) -> tuple[Column, Column]:
    both = mask_a.bitwiseAND(mask_b)
    return F.bit_count(code_a.bitwiseXOR(code_b).bitwiseAND(both)).cast("long"), F.bit_count(both).cast("long")


def fhd(hd: Column, md: Column) -> Column:
    """The fraction, null for an empty mask."""
    return F.when(md > 0, hd.cast("double") / md.cast("double"))


def dot(hd: Column, md: Column) -> Column:
    """The inner product of the codes in +1 and -1 form."""
    return md - 2 * hd


def nhd_numerator(hd: Column, md: Column) -> Column:
    return md * (20 * hd - 9 * md) + 147456 * hd


def nhd(hd: Column, md: Column) -> Column:
    return F.when(md > 0, nhd_numerator(hd, md).cast("double") / md.cast("double"))


def close(hd: Column, md: Column, threshold: float = STRICT) -> Column:
    """Strictly below the threshold; false for an empty mask."""
    return (md > 0) & (hd.cast("double") < md.cast("double") * F.lit(threshold))


def rotated(x: Column, by: Column, width: int = 32) -> Column:
    """``x`` as ``width`` bits, rotated left by ``by`` (negative: right)."""
    n = F.pmod(by, F.lit(width)).cast("int")
    low = F.lit((1 << width) - 1).cast("long")
    return F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftright", x, (F.lit(width) - n).cast("int"))).bitwiseAND(low)


def int4_dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of small integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


# Full-width codes, for files in the interchange format. Rows are codes, columns their 12,800 bits in storage order.


def decode_base64(text: str):
    """The bits of a base64 code: 200 big-endian words, the first bit on top."""
    import base64

    import numpy as np

    raw = np.frombuffer(base64.b64decode(text), np.uint8)
    if len(raw) != CODE_BITS // 8:
        raise ValueError("a code has 12,800 bits")
    return np.unpackbits(raw)


def encode_base64(code) -> str:
    import base64

    import numpy as np

    return base64.b64encode(np.packbits(code).tobytes()).decode()


def rotate(code, by: int):
    """Rotate a full code left by ``by`` columns: each block of 800 bits by four bits a column."""
    import numpy as np

    return np.roll(code.reshape(-1, BLOCK), -4 * by, axis=1).reshape(-1)


def distance_pair(code_a, mask_a, code_b, mask_b) -> tuple[int, int]:
    both = mask_a & mask_b
    return int(((code_a ^ code_b) & both).sum()), int(both.sum())


def least_rotation(code_a, mask_a, code_b, mask_b, rotations: int = 31, normalised: bool = False) -> tuple[int, int]:
    """The least distance over centred rotations; the first wins a tie; (65535, 65535) if no mask overlaps."""
    best, value = (65535, 65535), None
    for by in range(-(rotations // 2), rotations // 2 + 1):
        hd, md = distance_pair(code_a, mask_a, rotate(code_b, by), rotate(mask_b, by))
        if md:
            now = (md * (20 * hd - 9 * md) + 147456 * hd) / md if normalised else hd / md
            if value is None or now < value:
                best, value = (hd, md), now
    return best


def nibbles(packed: bytes):
    """Signed four-bit integers, the low one of each byte first."""
    import numpy as np

    raw = np.frombuffer(packed, np.uint8)
    both = np.stack([raw & 15, raw >> 4], axis=1).reshape(-1).astype(np.int8)
    return np.where(both > 7, both - 16, both)


def pack_nibbles(values) -> bytes:
    import numpy as np

    v = np.asarray(values, np.int64) & 15
    return (v[0::2] | v[1::2] << 4).astype(np.uint8).tobytes()
