"""What the operators of this subpackage share: table access, scratch tables, the held-out rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the body of a character class. Java, RE2 and Python read it alike.
SPACE = r"\x20\x09-\x0D"
#: A word: a run of anything else.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder. On a cluster a machine-local
    folder would lose rows, so a missing setting is an error there.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.maskwell.scratch", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.maskwell.scratch", root)
    return root


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From here on, Arrow batches of this session hold about ``most`` bytes, unless it asks for less.

    JVM and Python each keep several batches of a task, outside the heap; rows alone don't bound texts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most:
        spark.conf.set(key, str(most))


def slices(batch, column: int, rows: int = 256, most: int = 1 << 20):
    """Slices of an Arrow batch, of at most ``rows`` rows and ``most`` bytes in a binary column; a longer value is alone."""
    import pyarrow.compute as pc

    begin, total = 0, 0
    for n, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if n > begin and (n - begin >= rows or total + size > most):
            yield batch.slice(begin, n - begin)
            begin, total = n, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task still counts for its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation, and what is read twice is computed
    once. The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/maskwell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, although ``body`` may use it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_slices(df: DataFrame, function, schema, rows: int = 256) -> DataFrame:
    """``df`` through ``function``, which gets a dict of lists (a slice of at most ``rows`` rows) and returns another.

    Arrow carries the rows; only a slice at a time becomes Python objects. ``schema`` is a DDL string or a StructType; the lists that
    ``function`` returns may be of any equal length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows).to_pydict())
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)
