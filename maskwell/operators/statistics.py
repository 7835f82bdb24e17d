"""Distance histograms, accuracy reports and order-free set hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import distance as D
from ..registry import query
from ..sources import fixtures as X
from . import matching as M

BUCKETS = 15


def bucket(x: Column, top: float = D.LOOSE) -> Column:
    """Equal buckets from 0 to ``top``, numbered from 1."""
    return F.width_bucket(x, F.lit(0.0), F.lit(top), F.lit(BUCKETS)).cast("long")


_B = f"floor({BUCKETS} * ({{x}}) / 0.375::DOUBLE + 1)::BIGINT"


@query("hist_1d", f"WITH {X.CODES} SELECT eye, {_B.format(x='hd::DOUBLE / md')} AS bucket, count(*) AS n FROM pairs WHERE md > 0 AND hd < md * 0.375::DOUBLE GROUP BY ALL")
def hist_1d(spark, sf_dir):
    """How many distances of each eye fall in each bucket; distances are counted where they are made."""

    def kernel(q, d):
        import numpy as np

        n = {eye: np.zeros(B.WIDTH * B.WIDTH, np.int64) for eye, _ in M.EYES}
        for at in B.strips(q, d):
            for (eye, _), s in zip(M.EYES, M.both_sides(q, d, at)):
                n[eye] += np.bincount(s.place()[s.close(D.LOOSE)], minlength=B.WIDTH * B.WIDTH)
        for eye, each in n.items():
            md, hd = np.divmod(np.flatnonzero(each), B.WIDTH)
            yield [B.said(eye, len(hd)), hd, md, each[each > 0]]

    p = B.compared(*M.sides(spark, sf_dir), kernel, "eye string, hd bigint, md bigint, n bigint")
    return p.groupBy("eye", bucket(D.fhd(F.col("hd"), F.col("md"))).alias("bucket")).agg(F.sum("n").alias("n"))


@query("hist_2d", f"{M.WITH} SELECT {_B.format(x='hd_l::DOUBLE / md_l')} AS left_bucket, {_B.format(x='hd_r::DOUBLE / md_r')} AS right_bucket, count(*) AS n FROM wide WHERE md_l > 0 AND md_r > 0 AND hd_l < md_l * 0.375::DOUBLE AND hd_r < md_r * 0.375::DOUBLE GROUP BY ALL")
def hist_2d(spark, sf_dir):
    p = M.both_eyes(spark, sf_dir, lambda left, right: M.both_match(left, right, D.LOOSE))
    b = lambda s: bucket(D.fhd(F.col(f"hd_{s}"), F.col(f"md_{s}")))
    return p.groupBy(b("l").alias("left_bucket"), b("r").alias("right_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("hist_job_gate", f"WITH {X.CODES}, n AS (SELECT eye, count(*) AS n FROM pairs WHERE md > 0 AND hd < md * 0.345::DOUBLE GROUP BY eye) SELECT eye, n, least(n, 1000) AS used, n >= 100 AS enough FROM n")
def hist_job_gate(spark, sf_dir):
    """A report is made only of enough rows, and of no more than a cap."""
    n = M.match_counters(spark, sf_dir).groupBy("eye").agg(F.sum("n").alias("n"))
    return n.select("eye", "n", F.least("n", F.lit(1000)).alias("used"), (F.col("n") >= 100).alias("enough"))


@query("distance_bundles", f"WITH {X.CODES} SELECT req * 4294967296 + serial AS match_id, list(hd ORDER BY eye) AS distances FROM pairs WHERE md > 0 AND hd < md * 0.345::DOUBLE GROUP BY ALL")
def distance_bundles(spark, sf_dir):
    """The distances of a query and a row together, under one id."""

    def bundled(q, d, at):
        import numpy as np

        pair = M.both_sides(q, d, at)
        close = np.stack([s.close(D.STRICT).ravel() for s in pair], axis=1)
        hd = np.stack([s.hd.ravel() for s in pair], axis=1)
        return close.any(axis=1), lambda part: B.lists(close[part], hd[part].astype(np.int64))

    rows = B.compared(*M.sides(spark, sf_dir), B.matches(bundled), "req bigint, serial bigint, distances array<bigint>")
    rows = rows.select((F.col("req") * F.lit(1 << 32) + F.col("serial")).alias("match_id"), "distances")
    return M.one_row(rows, spark, sf_dir, lambda r: M.eye_pairs(spark, sf_dir, lambda s: s.close(D.STRICT)).groupBy((F.col("req") * F.lit(1 << 32) + F.col("serial")).alias("match_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("eye", "hd"))), lambda x: x["hd"]).alias("distances")))


def trials(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 40).alias("id"), (F.col("event_id") % 7 - 3).alias("rot"), (F.floor(F.col("value").cast("double") * 10).cast("long") % 1000).alias("mutation"), (F.col("event_id") % 5 != 0).alias("found"))


TRIALS = "WITH t AS (SELECT event_id % 40 AS id, event_id % 7 - 3 AS rot, floor(value * 10)::BIGINT % 1000 AS mutation, event_id % 5 <> 0 AS found FROM events)"


@query("accuracy_rate", f"{TRIALS} SELECT mutation, rot, count(*) AS n, avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM t GROUP BY ALL")
def accuracy_rate(spark, sf_dir):
    return trials(spark, sf_dir).groupBy("mutation", "rot").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("double")).alias("rate"))


@query("accuracy_hist", f"{TRIALS}, f AS (SELECT id, rot, coalesce(min(CASE WHEN NOT found THEN mutation END), 1000) AS fails_at FROM t GROUP BY ALL) SELECT rot, fails_at, count(*) AS n FROM f GROUP BY ALL")
def accuracy_hist(spark, sf_dir):
    """The least mutation at which each sample is missed, 1000 if it never is."""
    f = trials(spark, sf_dir).groupBy("id", "rot").agg(F.coalesce(F.min(F.when(~F.col("found"), F.col("mutation"))), F.lit(1000)).alias("fails_at"))
    return f.groupBy("rot", "fails_at").agg(F.count(F.lit(1)).alias("n"))


def set_hash(*columns: str) -> Column:
    """A hash of a multiset that doesn't depend on order: rows add up, and taking one away is a subtraction."""
    return (F.sum(F.xxhash64(*columns).cast("decimal(38,0)")) % F.lit(1 << 61).cast("decimal(38,0)")).cast("long")


@query("set_hash")
def set_hash_query(spark, sf_dir):
    return X.codes(spark, sf_dir).groupBy("eye").agg(set_hash("serial", "code", "mask").alias("hash"), F.count(F.lit(1)).alias("n"))


@query("range_hash_divergence", "SELECT c_custkey // 100 AS range, count(*) AS n FROM customer WHERE c_custkey % 333 = 5 GROUP BY 1")
def range_hash_divergence(spark, sf_dir):
    """Ranges in which two stores differ, by range hashes; only those need a closer look."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    other = c.withColumn("c_name", F.when(F.col("id") % 333 == 5, F.lit("changed")).otherwise(F.col("c_name")))
    hashed = lambda d, name: d.groupBy(F.expr("id DIV 100").alias("range")).agg(set_hash("id", "c_name").alias(name))
    bad = hashed(c, "h").join(hashed(other, "o"), "range", "full_outer").where(~F.col("h").eqNullSafe(F.col("o"))).select("range")
    pairs = c.withColumn("range", F.expr("id DIV 100")).join(F.broadcast(bad), "range").join(other.toDF("id", "b"), "id")
    return pairs.where(~F.col("c_name").eqNullSafe(F.col("b"))).groupBy("range").agg(F.count(F.lit(1)).alias("n"))


@query("report_windows", "SELECT event_id AS report, ts AS ends, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS starts FROM events")
def report_windows(spark, sf_dir):
    """Each report begins where the one before it ended."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("report"), F.col("ts").alias("ends"), F.lag("ts").over(w).alias("starts"))


@query("queue_age", f"WITH {X.INGESTED} SELECT count(*) AS backlog, min(received_at) AS oldest, count(*) FILTER (is_valid IS NULL) AS unknown FROM ingested WHERE persisted_at IS NULL")
def queue_age(spark, sf_dir):
    return X.ingested(spark, sf_dir).where("persisted_at IS NULL").agg(F.count(F.lit(1)).alias("backlog"), F.min("received_at").alias("oldest"), F.count_if(F.col("is_valid").isNull()).alias("unknown"))
