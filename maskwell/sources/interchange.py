"""Readers and writers of the interchange formats: line JSON codes, int4 vectors, fixed-width snapshot records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the snapshot record: big-endian id, code and mask as two byte planes for each eye, big-endian version.
CODE_SIZE, MASK_SIZE = 12800, 6400
RECORD = 4 + 2 * (2 * CODE_SIZE + 2 * MASK_SIZE) + 2


def read_codes(spark: SparkSession, path: str, select: str = "all", limit: int | None = None) -> DataFrame:
    """``line, iris_codes, mask_codes`` from line JSON; all lines, or those with an even or odd number.

    Line numbers need the file's order, which one task per file keeps; files are read whole for that reason.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''")
    rows = lines.select("line", F.from_json("value", "iris_codes string, mask_codes string").alias("j")).select("line", "j.*")
    if select != "all":
        rows = rows.where(F.col("line") % 2 == (0 if select == "even" else 1))
    return rows.orderBy("line").limit(limit) if limit is not None else rows


def read_knn(spark: SparkSession, path: str) -> DataFrame:
    """``node, neighbors`` from a result file: a header line, which isn't an object with a node, then line JSON."""
    return spark.read.schema("node bigint, neighbors array<bigint>").json(path).where("node IS NOT NULL")


def write_rates(df: DataFrame, path: str) -> None:
    """Accuracy figures as CSV with a header, in one folder."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_int4(spark: SparkSession, path: str) -> DataFrame:
    """``packed`` (binary, two signed nibbles a byte) from line JSON."""
    return spark.read.schema("packed_b64 string").json(path).select(F.unbase64("packed_b64").alias("packed"))


def write_int4(df: DataFrame, path: str) -> None:
    df.select(F.base64("packed").alias("packed_b64")).write.mode("overwrite").json(path)


def decode_records(data: bytes):
    """(id, version, left code, left mask, right code, right mask) for each record; 16-bit values from two byte planes."""
    import numpy as np

    if len(data) % RECORD:
        raise ValueError("a snapshot chunk holds whole records only")
    for k in range(0, len(data), RECORD):
        at, parts = k + 4, []
        for size in (CODE_SIZE, MASK_SIZE, CODE_SIZE, MASK_SIZE):
            high, low = (np.frombuffer(data, np.int8, size, at + j * size).astype(np.int32) + 128 for j in (0, 1))
            parts.append((high * 256 + low).astype(np.uint16))
            at += 2 * size
        yield int.from_bytes(data[k : k + 4], "big"), int.from_bytes(data[at : at + 2], "big", signed=True), *parts


def encode_record(serial: int, version: int, *parts) -> bytes:
    import numpy as np

    planes = b"".join((np.asarray(p, np.int32) // 256 - 128).astype(np.int8).tobytes() + (np.asarray(p, np.int32) % 256 - 128).astype(np.int8).tobytes() for p in parts)
    return serial.to_bytes(4, "big") + planes + version.to_bytes(2, "big", signed=True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``id, version, left_code, left_mask, right_code, right_mask`` (little-endian 16-bit values) from chunk files.

    A failed chunk is read again by Spark's own task retry.
    """
    schema = "id bigint, version smallint, left_code binary, left_mask binary, right_code binary, right_mask binary"

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                rows = [(i, v, *(p.tobytes() for p in parts)) for i, v, *parts in decode_records(data)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)
