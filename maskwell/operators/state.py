"""State tables, logs, checkpoints, exports: merges that rewrite, rollbacks that filter, order-free digests.

Tables are immutable files, so every write is a new version of a table that a reader swaps in. Digests add numbers up
modulo a prime, so that they don't depend on the order of rows and are summed in the map tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import fixtures as X
from .changelog import PARTIES, parties
from .graphs import GRAPH, edges, nodes

LOG = f"WITH {X.CHANGES} "
#: A prime for digests; sums of a billion terms below it stay far from the end of 64 bits.
PRIME = 2147483647


def digest(*columns: str) -> Column:
    """A number below ``PRIME`` for a row."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = (total * 1000003 + F.col(c) + 17) % PRIME
    return total


def digest_sql(*columns: str) -> str:
    total = "0::BIGINT"
    for c in columns:
        total = f"(({total}) * 1000003 + {c} + 17) % {PRIME}"
    return total


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key: one shuffle, no update in place."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


@query("scan_ordered", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey >= 1")
def scan_ordered(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").where("c_custkey >= 1").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("id")


@query("point_lookup", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, sf_dir):
    """A filter that reaches the scan: row groups without the id are never read."""
    return X.table(spark, sf_dir, "customer").where("c_custkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("mark_persisted", f"WITH {X.INGESTED} SELECT sequence_number, persisted_at IS NOT NULL OR sequence_number IN (SELECT lpad(o_orderkey::VARCHAR, 40, '0') FROM orders WHERE o_orderkey % 3 = 0) AS persisted FROM ingested")
def mark_persisted(spark, sf_dir):
    keys = X.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 40, "0").alias("sequence_number")).distinct().withColumn("named", F.lit(True))
    return X.ingested(spark, sf_dir).join(keys, "sequence_number", "left").select("sequence_number", (F.col("persisted_at").isNotNull() | F.coalesce("named", F.lit(False))).alias("persisted"))


@query("wal_upsert", f"{LOG}, o AS (SELECT id, request_type AS mutation FROM mods WHERE id % 3 <> 0), n AS (SELECT id, request_type || ':' || serial_id AS mutation FROM mods WHERE id % 2 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.mutation, o.mutation) AS mutation FROM o FULL JOIN n ON o.id = n.id")
def wal_upsert(spark, sf_dir):
    m = X.changes(spark, sf_dir)
    old = m.where("id % 3 <> 0").select("id", F.col("request_type").alias("mutation"))
    return merge(old, m.where("id % 2 = 0").select("id", F.concat_ws(":", "request_type", "serial_id").alias("mutation")), "id")


@query("state_upsert", "WITH n AS (SELECT event_type AS key, max(event_id) AS value FROM events GROUP BY 1), o AS (SELECT unnest(['click', 'start', 'last_indexed']) AS key, unnest([-1, -2, -3])::BIGINT AS value) SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.key = n.key")
def state_upsert(spark, sf_dir):
    old = spark.createDataFrame([("click", -1), ("start", -2), ("last_indexed", -3)], "key string, value bigint")
    new = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").cast("long").alias("value"))
    return merge(old, new, "key")


@query("watermarks", f"{LOG} SELECT 'last_indexed_iris_id' AS key, max(serial_id)::BIGINT AS value FROM mods WHERE status = 'COMPLETED' UNION ALL SELECT 'last_indexed_modification_id', max(id) FROM mods WHERE status = 'COMPLETED'")
def watermarks(spark, sf_dir):
    """How far the index has come, as rows of the state table."""
    m = X.changes(spark, sf_dir).where("status = 'COMPLETED'").agg(F.max("serial_id").cast("long").alias("last_indexed_iris_id"), F.max("id").cast("long").alias("last_indexed_modification_id"))
    return m.unpivot([], ["last_indexed_iris_id", "last_indexed_modification_id"], "key", "value")


CATALOGUE = "cat AS (SELECT o_orderkey AS id, o_custkey % 40 AS height, o_orderkey % 7 = 0 AS archival, o_orderkey % 5 = 0 AS deleted FROM orders)"


def catalogue(spark, sf_dir) -> DataFrame:
    """Checkpoints: ``id, height, archival, deleted``."""
    k = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 40).alias("height"), (k % 7 == 0).alias("archival"), (k % 5 == 0).alias("deleted"))


@query("checkpoint_soft_delete", f"WITH {CATALOGUE} SELECT id, deleted OR (height < 8 AND NOT archival) AS deleted FROM cat UNION ALL SELECT max(id) + 1, false FROM cat")
def checkpoint_soft_delete(spark, sf_dir):
    """A new checkpoint is appended, and old ones that aren't archival are flagged, not removed."""
    c = catalogue(spark, sf_dir)
    flagged = c.select("id", (F.col("deleted") | ((F.col("height") < 8) & ~F.col("archival"))).alias("deleted"))
    return flagged.union(c.agg((F.max("id") + 1).alias("id")).withColumn("deleted", F.lit(False)))


@query("checkpoint_rollback", f"WITH {CATALOGUE}, b AS (SELECT max(id) AS id FROM cat WHERE height = 20 AND NOT deleted) SELECT cat.id, height FROM cat, b WHERE cat.id <= b.id")
def checkpoint_rollback(spark, sf_dir):
    """Everything after the newest live checkpoint of a height goes."""
    c = catalogue(spark, sf_dir)
    base = c.where("height = 20 AND NOT deleted").agg(F.max("id").alias("base"))
    return c.crossJoin(F.broadcast(base)).where("id <= base").select("id", "height")  # base is one row


@query("marks_agree", f"WITH {CATALOGUE}, s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 211 = 4 THEN -1 ELSE o_custkey % 40 END AS height FROM orders WHERE o_orderkey % 307 <> 5) SELECT coalesce(cat.id, s.id) AS id, cat.height AS marked, s.height AS stated FROM cat FULL JOIN s ON cat.id = s.id WHERE cat.height IS DISTINCT FROM s.height")
def marks_agree(spark, sf_dir):
    """Checkpoints whose marks differ from the state table's; no rows mean agreement."""
    s = X.table(spark, sf_dir, "orders").where("o_orderkey % 307 <> 5").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 211 = 4 THEN -1 ELSE o_custkey % 40 END").alias("stated"))
    rows = catalogue(spark, sf_dir).select("id", F.col("height").alias("marked")).join(s, "id", "full_outer")
    return rows.where(~F.col("marked").eqNullSafe(F.col("stated")))


def materialised(log: DataFrame, height: Column | int) -> DataFrame:
    """The state that a change log has made up to a height: the last change of each serial."""
    return log.where(F.col("id") <= height).groupBy("serial_id").agg(F.max_by(F.struct("id", "request_type"), "id").alias("m")).select("serial_id", "m.*")


def rolled_forward(state: DataFrame, log: DataFrame, after: int) -> DataFrame:
    """``state`` with the changes after a checkpoint applied in order: the last one of each serial wins."""
    return merge(state, materialised(log.where(F.col("id") > after), F.lit(1 << 62)), "serial_id")


@query("wal_roll_forward", f"{LOG} SELECT serial_id, max(id) AS id, arg_max(request_type, id) AS request_type FROM mods GROUP BY serial_id")
def wal_roll_forward(spark, sf_dir):
    """Restart: a checkpoint's state and the log after it give the state that the whole log gives."""
    log = X.changes(spark, sf_dir)
    height = log.agg(F.floor(F.max("id") / 2)).first()[0] or 0
    return rolled_forward(materialised(log, height), log, height).select("serial_id", "id", "request_type")


GAPS = f"{PARTIES}, w AS (SELECT *, CASE WHEN status = 'COMPLETED' AND id % (party + 2) <> 0 THEN 'm' || id || request_type END AS mutation FROM p)"


@query("wal_gap_fill", f"{GAPS}, g AS (SELECT id, bool_or(status = 'COMPLETED') AS done, max(mutation) AS known, max(CASE WHEN party = 0 THEN mutation END) AS own, bool_or(party = 0 AND status = 'COMPLETED') AS mine FROM w GROUP BY id) SELECT id, known AS mutation FROM g WHERE done AND own IS NULL AND known IS NOT NULL")
def wal_gap_fill(spark, sf_dir):
    """Mutations that party 0 lacks and takes over from any party that has them."""
    w = parties(spark, sf_dir).withColumn("mutation", F.when((F.col("status") == "COMPLETED") & (F.col("id") % (F.col("party") + 2) != 0), F.concat(F.lit("m"), "id", "request_type")))
    g = w.groupBy("id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("done"), F.max("mutation").alias("mutation"), F.max(F.when(F.col("party") == 0, F.col("mutation"))).alias("own"))
    return g.where("done AND own IS NULL AND mutation IS NOT NULL").select("id", "mutation")


@query("repair_union", f"{PARTIES} SELECT DISTINCT serial_id FROM p WHERE status <> 'COMPLETED' OR NOT persisted")
def repair_union(spark, sf_dir):
    """Serials that any peer has to repair."""
    p = parties(spark, sf_dir)
    lists = [p.where((F.col("party") == k) & ((F.col("status") != "COMPLETED") | ~F.col("persisted"))).select("serial_id") for k in range(3)]
    return lists[0].union(lists[1]).union(lists[2]).distinct()


@query("checkpoint_cycle", f"{PARTIES}, h AS (SELECT min(m) AS height FROM (SELECT party, max(id) AS m FROM p WHERE status = 'COMPLETED' GROUP BY party)), s AS (SELECT party, serial_id, max(id) AS id FROM p, h WHERE p.id <= height AND (party <> 1 OR p.id % 157 <> 9) GROUP BY ALL), d AS (SELECT party, count(*) AS n, (sum({digest_sql('serial_id', 'id')}) % {PRIME})::BIGINT AS digest FROM s GROUP BY party) SELECT party, height, n, digest, digest = median(digest) OVER () AS agrees FROM d, h")
def checkpoint_cycle(spark, sf_dir):
    """Freeze at the height that all parties have reached, materialise the state there, and compare digests with the majority's."""
    p = parties(spark, sf_dir)
    height = p.where("status = 'COMPLETED'").groupBy("party").agg(F.max("id").alias("m")).agg(F.min("m").alias("height"))
    kept = p.crossJoin(F.broadcast(height)).where("id <= height AND (party <> 1 OR id % 157 <> 9)")  # height is one row
    states = kept.groupBy("party", "serial_id").agg(F.max("id").alias("id"), F.any_value("height").alias("height"))
    d = states.groupBy("party").agg(F.any_value("height").alias("height"), F.count(F.lit(1)).alias("n"), (F.sum(digest("serial_id", "id")) % PRIME).alias("digest"))
    return d.withColumn("agrees", F.col("digest") == F.median("digest").over(Window.partitionBy(F.lit(0))))  # a row a party


@query("set_digest_keyed", f"SELECT c_custkey AS key, (coalesce(sum(CASE WHEN o_orderkey IS NULL THEN {digest_sql('c_custkey')} ELSE {digest_sql('c_custkey', 'o_orderkey')} END), 0) % {PRIME})::BIGINT AS digest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 9 = 0 GROUP BY c_custkey")
def set_digest_keyed(spark, sf_dir):
    """A digest of each key's set; an empty set has a marker of its own, so that it differs from a missing key."""
    o = X.table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("item"))
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(o, "key", "left")
    return rows.groupBy("key").agg((F.sum(F.when(F.col("item").isNull(), digest("key")).otherwise(digest("key", "item"))) % PRIME).alias("digest"))


@query("graph_checksum", f"WITH {GRAPH} SELECT layer, count(*) AS n, (sum({digest_sql('layer', 'src', 'dst')}) % {PRIME})::BIGINT AS checksum FROM edges GROUP BY ROLLUP (layer)")
def graph_checksum(spark, sf_dir):
    """Order-free checksums of each layer's edges and, with a null layer, of the graph."""
    return edges(spark, sf_dir).rollup("layer").agg(F.count(F.lit(1)).alias("n"), (F.sum(digest("layer", "src", "dst")) % PRIME).alias("checksum"))


@query("graph_statistics", f"WITH {GRAPH}, d AS (SELECT layer, src, count(*) AS n FROM edges GROUP BY ALL) SELECT nodes.layer, count(*) AS nodes, count(d.n) AS with_edges, coalesce(sum(d.n), 0)::BIGINT AS edges, max(coalesce(d.n, 0)) AS most, min(coalesce(d.n, 0)) AS least FROM nodes LEFT JOIN d ON d.layer = nodes.layer AND d.src = nodes.serial GROUP BY nodes.layer")
def graph_statistics(spark, sf_dir):
    """Nodes, edges and outgoing degrees of each layer; nodes without edges count."""
    d = edges(spark, sf_dir).groupBy("layer", F.col("src").alias("serial")).agg(F.count(F.lit(1)).alias("n"))
    rows = nodes(spark, sf_dir).join(d, ["layer", "serial"], "left")
    degree = F.coalesce("n", F.lit(0))
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"), F.count("n").alias("with_edges"), F.sum(degree).alias("edges"), F.max(degree).alias("most"), F.min(degree).alias("least"))


@query("current_versions", f"WITH {GRAPH} SELECT c_custkey AS serial, max(n.version) AS version FROM customer LEFT JOIN nodes n ON n.serial = c_custkey AND n.layer = 0 AND c_custkey % 17 <> 3 GROUP BY c_custkey")
def current_versions(spark, sf_dir):
    """The version under which the graph holds each serial; null where it holds none."""
    n = nodes(spark, sf_dir).where("layer = 0 AND serial % 17 <> 3").groupBy("serial").agg(F.max("version").alias("version"))
    return X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial")).join(n, "serial", "left")


@query("temporary_entry", f"WITH {GRAPH} SELECT arg_min(serial, (-layer) * 100000000 + serial) AS serial, max(layer) AS layer FROM nodes")
def temporary_entry(spark, sf_dir):
    """Without an entry point, the lowest id of the highest layer serves."""
    first = nodes(spark, sf_dir).agg(F.min(F.struct((-F.col("layer")).alias("down"), "serial")).alias("f"))
    return first.select("f.serial", (-F.col("f.down")).alias("layer"))


@query("stale_lookup", "SELECT e.event_id, c.c_name IS NOT NULL AND e.event_id % 3 = c.c_custkey % 3 AS current, CASE WHEN e.event_id % 3 = c.c_custkey % 3 THEN c.c_name ELSE '' END AS value FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def stale_lookup(spark, sf_dir):
    """A look-up under an outdated version, or of a serial that isn't there, finds the empty value."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", (F.col("c_custkey") % 3).alias("version"))
    rows = X.table(spark, sf_dir, "events").select("event_id", "user_id").join(c, "user_id", "left")
    current = F.coalesce(F.col("event_id") % 3 == F.col("version"), F.lit(False))
    return rows.select("event_id", current.alias("current"), F.when(current, F.col("c_name")).otherwise("").alias("value"))


@query("deletions_overlay", "SELECT c_custkey AS serial, CASE WHEN c_custkey % 23 = 0 THEN c_custkey % 5 + 1 ELSE c_custkey % 5 END AS version, CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE 65535 END::BIGINT AS mask, c_custkey % 23 <> 0 AS can_match FROM customer")
def deletions_overlay(spark, sf_dir):
    """Deletions come before the search: the row's version rises, and its empty mask keeps it at the greatest distance."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial"), (F.col("c_custkey") % 5).alias("version"), F.lit(65535).cast("long").alias("mask"))
    gone = c.where("serial % 23 = 0").select("serial", F.lit(True).alias("gone"))
    rows = c.join(gone, "serial", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return rows.select("serial", (F.col("version") + F.col("gone").cast("long")).alias("version"), F.when(F.col("gone"), 0).otherwise(F.col("mask")).cast("long").alias("mask"), (~F.col("gone")).alias("can_match"))


@query("operation_counters", "SELECT event_type AS operation, count(*) AS n, count(DISTINCT user_id) AS keys, max(n_key) AS most FROM (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS n_key FROM events) GROUP BY 1")
def operation_counters(spark, sf_dir):
    """How often each operation ran, for how many keys, and how often for the busiest key."""
    each = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("operation"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("operation").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.max("n").alias("most"))


@query("histogram_records", "SELECT b AS bucket, b * 0.05::DOUBLE AS lo, (b + 1) * 0.05::DOUBLE AS hi, count(*) AS n FROM (SELECT floor(event_id * 37 % 1000 / 50.0)::BIGINT AS b FROM events) GROUP BY b")
def histogram_records(spark, sf_dir):
    """Counts with the bounds of their buckets."""
    b = X.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") * 37 % 1000 / 50).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return b.select("bucket", (F.col("bucket") * F.lit(0.05)).alias("lo"), ((F.col("bucket") + 1) * F.lit(0.05)).alias("hi"), "n")


@query("delta_decode", "SELECT c_custkey AS src, j AS pos, (c_custkey + sum((c_custkey * j) % 13 + 1) OVER (PARTITION BY c_custkey ORDER BY j))::BIGINT AS id FROM customer, (SELECT unnest(range(0, 8)) AS j)")
def delta_decode(spark, sf_dir):
    """Neighbour lists that are stored as gaps, decoded inside the row by running sums."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: (F.col("c_custkey") * j) % 13 + 1)
    sums = F.transform("gaps", lambda g, i: F.aggregate(F.slice("gaps", 1, i + 1), F.col("c_custkey"), lambda a, x: a + x))
    return X.table(spark, sf_dir, "customer").select("c_custkey", gaps.alias("gaps")).select(F.col("c_custkey").alias("src"), F.posexplode(sums).alias("pos", "id")).select("src", F.col("pos").cast("long").alias("pos"), "id")


@query("expanded_neighbourhoods", "WITH op AS (SELECT event_id, user_id AS base, event_id % 3 AS kind, [event_id * 7 % 90, event_id * 11 % 90] AS near FROM events WHERE event_type = 'click') SELECT DISTINCT serial, n FROM (SELECT base AS serial, event_id % 2 AS n FROM op WHERE kind IN (0, 2) UNION ALL SELECT unnest(near), event_id % 2 FROM op WHERE kind IN (1, 2))")
def expanded_neighbourhoods(spark, sf_dir):
    """Neighbourhoods that added edges may have made longer: the base's, its neighbours', or both, by the kind of edge."""
    k = F.col("event_id")
    near = F.array(k * 7 % 90, k * 11 % 90)
    grown = F.when(k % 3 == 0, F.array(F.col("user_id"))).when(k % 3 == 1, near).otherwise(F.concat(F.array(F.col("user_id")), near))
    return X.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.explode(grown).alias("serial"), (k % 2).alias("n")).distinct()


def export(rows: DataFrame, out: str, since: str | None = None, time: str = "last_modified_at") -> None:
    """Write a complete export, or with ``since`` append what has changed from then on; both by day, as Parquet."""
    by_day = rows.withColumn("day", F.to_date(time))
    if since is None:
        by_day.write.mode("overwrite").partitionBy("day").parquet(out)
    else:
        by_day.where(F.col(time) >= F.lit(since).cast("timestamp")).write.mode("append").partitionBy("day").parquet(out)


def publish(results: DataFrame, out: str, kind: str = "message_type") -> None:
    """One topic for all results; the message type is an attribute that readers prune by."""
    results.write.mode("append").partitionBy(kind).json(out)


@query("export_increment", "SELECT event_id AS id, ts::DATE AS day FROM events WHERE ts::DATE >= (SELECT max(ts::DATE) FROM events) - INTERVAL 5 DAY")
def export_increment(spark, sf_dir):
    """What an incremental export appends: rows changed in the last days."""
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    last = e.agg(F.max("day").alias("last"))
    return e.crossJoin(F.broadcast(last)).where(F.col("day") >= F.date_sub("last", 5)).select("id", "day")  # last is one row


@query("neighbour_codec", "WITH g AS (SELECT c_custkey AS src, list_transform(range(0, 12), lambda j: c_custkey % 50 * j + j * j % 7 * j + j) AS ids FROM customer), h AS (SELECT src, ids, floor(log2(greatest(1, (ids[12] - 11) // 12)))::BIGINT AS b FROM g) SELECT src, 12::BIGINT AS n, (3 + (list_sum(list_transform(range(1, 13), lambda k: ((CASE WHEN k = 1 THEN ids[1] ELSE ids[k] - ids[k - 1] - 1 END) >> b::INT) + 1 + b)) + 7) // 8)::BIGINT AS bytes, list_sum(ids)::BIGINT AS total FROM h WHERE len(list_filter(range(2, 13), lambda k: ids[k] <= ids[k - 1])) = 0")
def neighbour_codec(spark, sf_dir):
    """Neighbour lists through the graph file's codec and back: their number, stored bytes and the sum of what was read."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.col("src") % 50 * j + j * j % 7 * j + j)
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src")).withColumn("ids", ids)
    rising = F.aggregate(F.sequence(F.lit(1), F.lit(11)), F.lit(True), lambda a, k: a & (F.get("ids", k) > F.get("ids", k - 1)))

    def run(batches):
        import pyarrow as pa

        from ..functions import codec

        for b in batches:
            coded = [codec.encode(x) for x in b.column(1).to_pylist()]
            back = [codec.decode(x) for x in coded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in back], pa.int64()), pa.array([len(x) for x in coded], pa.int64()), pa.array([sum(x) for x in back], pa.int64())], names=["src", "n", "bytes", "total"])

    return rows.where(rising).select(F.col("src").cast("long").alias("src"), F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(run, "src bigint, n bigint, bytes bigint, total bigint")
