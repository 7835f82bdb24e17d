"""Distances against plain definitions, in numpy and as column expressions."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskwell.functions import distance as D


def code(rng):
    return np.array([rng.randrange(2) for _ in range(D.CODE_BITS)], np.uint8)


def test_base64_round_trip_and_bit_order():
    c = np.zeros(D.CODE_BITS, np.uint8)
    c[0] = c[65] = 1
    text = D.encode_base64(c)
    assert (D.decode_base64(text) == c).all()
    import base64

    words = np.frombuffer(base64.b64decode(text), ">u8")
    assert words[0] == 1 << 63 and words[1] == 1 << 62


def test_rotation_is_a_group():
    rng = random.Random(1)
    c = code(rng)
    assert (D.rotate(D.rotate(c, 5), -5) == c).all()
    assert (D.rotate(c, D.COLUMNS) == c).all()
    assert D.rotate(c, 1)[0] == c[4] and D.rotate(c, 1)[796] == c[0]


def test_least_rotation_finds_the_shift():
    rng = random.Random(2)
    a, ones = code(rng), np.ones(D.CODE_BITS, np.uint8)
    for by in (-15, -3, 0, 7, 15):
        assert D.least_rotation(a, ones, D.rotate(a, -by), ones) == (0, D.CODE_BITS)
    assert D.least_rotation(a, ones, a, np.zeros(D.CODE_BITS, np.uint8)) == (65535, 65535)
    hd, md = D.least_rotation(a, ones, code(rng), ones, 3, normalised=True)
    assert md == D.CODE_BITS and 0.45 < hd / md < 0.55


def test_nibbles():
    v = np.arange(-8, 8)
    assert (D.nibbles(D.pack_nibbles(v)) == v).all()
    assert D.pack_nibbles([1, -1]) == b"\xf1"


def test_columns(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randrange(1 << 32) for _ in range(4)) for _ in range(50)] + [(1, 0, 2, 3), (0, (1 << 32) - 1, 0, (1 << 32) - 1)]
    df = spark.createDataFrame(rows, "a long, ma long, b long, mb long")
    hd, md = D.hd_md(F.col("a"), F.col("ma"), F.col("b"), F.col("mb"))
    got = df.select("*", hd.alias("hd"), md.alias("md")).select("*", D.fhd(F.col("hd"), F.col("md")).alias("f"), D.nhd(F.col("hd"), F.col("md")).alias("n"), D.close(F.col("hd"), F.col("md")).alias("c"), D.rotated(F.col("a"), F.lit(3)).alias("r3"), D.rotated(F.col("a"), F.lit(-1)).alias("r1")).collect()
    for r in got:
        m = r.ma & r.mb
        h, n = ((r.a ^ r.b) & m).bit_count(), m.bit_count()
        assert (r.hd, r.md) == (h, n)
        assert r.f == (h / n if n else None) and r.n == ((n * (20 * h - 9 * n) + 147456 * h) / n if n else None)
        assert r.c == (n > 0 and h < n * 0.345)
        assert r.r3 == (r.a << 3 | r.a >> 29) & 0xFFFFFFFF and r.r1 == (r.a >> 1 | r.a << 31) & 0xFFFFFFFF
