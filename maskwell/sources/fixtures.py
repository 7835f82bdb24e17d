"""Tables of the data model, derived from the driver's ``embeddings`` and ``events``; each with its SQL twin.

Codes are 32 sign bits an eye, masks the bits whose value is clear of zero. Queries are the vectors with an id divisible
by 10, the database holds the others.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 0.02
BITS = 32
#: Request batches are bounded; a query side of no more rows than this is broadcast.
BATCH_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int = BATCH_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows; otherwise the planner decides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="maskwell-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bits(vector: str, base: int, clear: bool = False) -> Column:
    """One bit a dimension: its sign, or whether it is clear of zero."""
    x = lambda i: F.get(F.col(vector), F.lit(base + i)).cast("double")
    on = (lambda i: F.abs(x(i)) > F.lit(EPS)) if clear else (lambda i: x(i) > F.lit(0.0))
    total = F.lit(0).cast("long")
    for i in range(BITS):
        total = total.bitwiseOR(F.when(on(i), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``serial, code_l, mask_l, code_r, mask_r``: both eyes in one row, so that no join brings them together."""
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") + 1).alias("serial"), bits("embedding", 0).alias("code_l"), bits("embedding", 0, True).alias("mask_l"), bits("embedding", BITS).alias("code_r"), bits("embedding", BITS, True).alias("mask_r"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``serial, eye, code, mask``: long form."""
    return eyes(spark, sf_dir).select("serial", F.expr("stack(2, 'L', code_l, mask_l, 'R', code_r, mask_r) AS (eye, code, mask)"))


def is_query() -> Column:
    return (F.col("serial") - 1) % 10 == 0


def requests(df: DataFrame) -> DataFrame:
    return df.where(is_query()).withColumnRenamed("serial", "req")


def database(df: DataFrame) -> DataFrame:
    return df.where(~is_query())


_BIT = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN {on} THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT"
_CODE, _MASK = _BIT.format(on="embedding[i + 1 + base]::DOUBLE > 0"), _BIT.format(on="abs(embedding[i + 1 + base]::DOUBLE) > 0.02::DOUBLE")
CODES = f"""codes AS (
  SELECT vec_id + 1 AS serial, eye, {_CODE} AS code, {_MASK} AS mask FROM embeddings, (VALUES ('L', 0), ('R', 32)) e(eye, base)),
  q AS (SELECT serial AS req, eye, code, mask FROM codes WHERE (serial - 1) % 10 = 0),
  d AS (SELECT * FROM codes WHERE (serial - 1) % 10 <> 0),
  pairs AS (SELECT req, serial, q.eye, bit_count(xor(q.code, d.code) & q.mask & d.mask)::BIGINT AS hd, bit_count(q.mask & d.mask)::BIGINT AS md FROM q JOIN d ON q.eye = d.eye)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: ``id, serial_id, request_type, status, persisted, created_at``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("id"), F.col("user_id").alias("serial_id"), F.col("event_type").alias("request_type"),
        F.when(F.col("event_id") % 7 == 0, "IN_PROGRESS").otherwise("COMPLETED").alias("status"), (F.col("event_id") % 3 != 0).alias("persisted"), F.col("ts").alias("created_at"),
    )


CHANGES = """mods AS (
  SELECT event_id + 1 AS id, user_id AS serial_id, event_type AS request_type,
         CASE WHEN event_id % 7 = 0 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status, event_id % 3 <> 0 AS persisted, ts AS created_at FROM events)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request queue: ``sequence_number`` (40 digits), ``body``, ``received_at``, claims, validity."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.lpad(k.cast("string"), 40, "0").alias("sequence_number"), F.col("props").alias("body"), F.col("ts").alias("received_at"),
        F.when(k % 5 == 0, k.cast("long")).alias("consumed_batch_id"), F.when(k % 4 == 0, F.col("ts")).alias("persisted_at"), F.when(k % 6 == 0, F.lit(None)).otherwise(k % 11 != 0).cast("boolean").alias("is_valid"),
    )


INGESTED = """ingested AS (
  SELECT lpad(event_id::VARCHAR, 40, '0') AS sequence_number, props AS body, ts AS received_at, CASE WHEN event_id % 5 = 0 THEN event_id END AS consumed_batch_id,
         CASE WHEN event_id % 4 = 0 THEN ts END AS persisted_at, CASE WHEN event_id % 6 <> 0 THEN event_id % 11 <> 0 END AS is_valid FROM events)"""
