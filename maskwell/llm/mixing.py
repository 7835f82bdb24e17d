"""Mix sources to target weights by hash-random order, distributed prefix sums and an exact cut.

Every document gets a random but repeatable key (a hash of its id). Within a source the documents stand in key order;
the key space is cut into equal ranges, which hold about as many rows each because keys are uniform, so a range sort
needs no sampling and a hot source is spread over as many tasks as it needs. Prefix sums of sizes run inside a range and
over the totals of the ranges. A source with target T and size S is read T div S times whole, and then up to the
document in which the rest of its budget ends.

Everything is DataFrame code; what reaches the driver are single sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Rows that one key range should hold, and the fewest ranges of a source.
RANGE_ROWS, MIN_RANGES = 65536, 256


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_key(column: str = "source") -> Column:
    """A join key without nulls: a null source differs from every named one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def random_key(seed: str = SEED) -> Column:
    """60 hash bits of the id. MD5, so that SQL engines can repeat it."""
    said = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the 0-based place of each row in a total order, without bringing all rows together.

    A range sort deals out the rows, each task numbers its own, and the counts of the tasks (one row each) give the
    starts. The range-sorted rows are staged first, as a second sampling could deal them differently.
    """
    part = "__part"
    dealt = stage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    starts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, local.cast("long")).join(starts.drop("__n"), part).withColumn(name, F.col(name) + F.col("__start")).drop(part, "__start")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: ``skey``, ``source_size``, ``target``.

    Sources in code-point order, null last, take the weights in turn and share the total by weight. No target passes
    ``max_repeats`` times its source's size; what is over goes to the others by weight. That ends in one level L with
    target = min(weight * L, cap), which is raised until no source is newly capped; a step is one aggregate.
    """
    sizes = sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__rank") % n + 1).cast("int"))
    rows = stage(ranked(sizes, [F.col("source").asc_nulls_last()], "__rank").withColumn("weight", turn).drop("__rank"), "sources")
    cap = F.lit(max_repeats) * F.col("source_size")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) >= cap
        capped, held, free = rows.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if capped == seen or not free:
            break
        level, seen = (total - held) / free, capped
    share = F.col("weight") * F.lit(float(level))
    return rows.withColumn("target", F.when(share >= cap, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """How often and how far the mix takes each document.

    Gives ``doc_id, source, size, source_size, target, epochs, partial, taken``: the document is taken ``epochs`` times
    whole and then ``partial`` words of it once, ``taken`` words in all. Sources hit their rounded targets exactly.

    Null or empty text: size 0 and nothing taken. Null source: a source of its own, last in order. Null id: hashes as
    the empty text. Ties of the key go by id and size; rows that agree in all of these are interchangeable. Empty
    table: no rows. Other columns of ``docs`` are not read.
    """
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key().alias("skey"), word_count().alias("size")), "sized")
    rows = sized.count()
    bits = max(int(math.log2(MIN_RANGES)), math.ceil(math.log2(max(1, rows) / RANGE_ROWS)))
    keyed = sized.withColumn("key", random_key(seed)).withColumn("range", F.shiftright("key", 60 - bits).cast("long"))
    targets = source_targets(sized, weights, max_repeats)
    before = lambda *by: F.coalesce(F.sum("size").over(Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = keyed.groupBy("skey", "range").agg(F.sum("size").alias("size"))
    starts = ranges.withColumn("start", before(["skey"], ["range"])).drop("size").join(targets.drop("source", "weight"), "skey")
    placed = keyed.withColumn("prefix", before(["skey", "range"], ["key", "doc_id", "size"])).join(starts, ["skey", "range"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV greatest(source_size, 1)")).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("prefix")
    return (
        placed.withColumn("epochs", whole)
        .withColumn("partial", F.least(F.greatest(rest, F.lit(0)), F.col("size")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "partial", (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``, each as often as the mix takes it.

    Documents stay whole: the one in which a source's budget ends is taken if at least half of it lies before the cut.
    A document of size 0 adds nothing to a mix and is left out. Rows that agree in id, source and size get the
    same number of copies on average: the copies of such a group are added up and dealt out one by one.
    """
    row, keys = "__row", ["__id", "__source", "__size"]
    taken = mix(docs, weights, max_repeats, seed)
    copies = F.when(F.col("size") > 0, F.col("epochs") + (2 * F.col("partial") >= F.col("size")).cast("long")).otherwise(0)
    same = taken.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), source_key().alias("__source"), F.col("size").alias("__size")).agg(F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__n"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), source_key().alias("__source"), word_count().alias("__size"))
    # Few groups have more than one row; only those need a place within the group.
    joined = own.join(same.where("__copies > 0"), keys)
    one = joined.where("__n = 1").withColumn("__k", F.lit(0).cast("long"))
    more = joined.where("__n > 1").withColumn("__k", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(row))) - 1).cast("long"))
    each = F.expr("__copies DIV __n + CAST(__k < __copies % __n AS BIGINT)")
    return one.unionByName(more).withColumn("__each", each).where("__each > 0").select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__each")))).select(f"{row}.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, sum(3 * s) OVER (ORDER BY 3 * s / w, source ROWS UNBOUNDED PRECEDING) AS held,
         sum(w) OVER () - sum(w) OVER (ORDER BY 3 * s / w, source ROWS UNBOUNDED PRECEDING) AS free,
         lead(3 * s / w) OVER (ORDER BY 3 * s / w, source) AS next
  FROM sources),
levels AS (
  SELECT (SELECT sum(s) FROM sources) / (SELECT sum(w) FROM sources)::DOUBLE AS level, -1.0 AS held, (SELECT min(3 * s / w) FROM sources) AS next
  UNION ALL
  SELECT CASE WHEN free > 0 THEN ((SELECT sum(s) FROM sources) - held)::DOUBLE / free END, held, next FROM steps),
level AS (SELECT level FROM levels WHERE level < next OR (next IS NULL AND level IS NOT NULL) ORDER BY held LIMIT 1),
targets AS (
  SELECT source, s, CASE WHEN w * coalesce(level, 0) >= 3 * s THEN (3 * s)::DOUBLE ELSE w * level END AS target
  FROM sources LEFT JOIN level ON true),
placed AS (
  SELECT doc_id, size, s AS source_size, target, sized.source, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, source,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(greatest(budget % source_size - prefix, 0), size) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
