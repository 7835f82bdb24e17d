"""Versioned rows, change logs, request queues and checkpoint catalogues as relational operators.

Tables are immutable files, so an update is a join that rewrites rows; a delete is a filter or an anti-join. Where a rule
needs the latest row of a key, partial aggregation with ``max_by`` does it, so that hot keys are reduced before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import fixtures as X

LOG, QUEUE = f"WITH {X.CHANGES} ", f"WITH {X.INGESTED} "
START, RETENTION_DAYS = "2024-01-01", 10


def upsert(old: DataFrame, new: DataFrame, key: str, payload: list[str], version: str = "version") -> DataFrame:
    """``old`` with the rows of ``new`` merged in by key.

    A row's version rises by one only if its payload changes (nulls compare as values); new keys begin at 0.
    """
    n = new.select(F.col(key).alias(f"{key}_n"), *[F.col(c).alias(f"{c}_n") for c in payload])
    rows = old.join(n, F.col(key) == F.col(f"{key}_n"), "full_outer")
    has_old, has_new = F.col(key).isNotNull(), F.col(f"{key}_n").isNotNull()
    changed = F.lit(False)
    for c in payload:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"{c}_n"))
    v = F.when(~has_old, F.lit(0)).when(has_new & changed, F.col(version) + 1).otherwise(F.col(version)).cast("long")
    return rows.select(F.coalesce(key, f"{key}_n").alias(key), *[F.when(has_new, F.col(f"{c}_n")).otherwise(F.col(c)).alias(c) for c in payload], v.alias(version))


@query("upsert_versions", "WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, 1::BIGINT AS version FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.bal ELSE o.bal END AS bal, CASE WHEN o.id IS NULL THEN 0 WHEN n.id IS NOT NULL AND (n.name IS DISTINCT FROM o.name OR n.bal IS DISTINCT FROM o.bal) THEN version + 1 ELSE version END::BIGINT AS version FROM o FULL JOIN n ON o.id = n.id")
def upsert_versions(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    old = c.where("id % 3 <> 0").withColumn("version", F.lit(1).cast("long"))
    new = c.where("id % 2 = 0").withColumn("name", F.when(F.col("id") % 5 != 0, F.col("name")))
    return upsert(old, new, "id", ["name", "bal"])


@query("explicit_versions", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 ELSE 1 END::BIGINT AS version FROM customer")
def explicit_versions(spark, sf_dir):
    """Replayed rows bring their version along, and it is taken as it is."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    given = c.where("id % 2 = 0").select("id", (F.col("id") % 9).alias("given"))
    return c.join(given, "id", "left").select("id", F.coalesce("given", F.lit(1)).cast("long").alias("version"))


@query("version_running", "WITH e AS (SELECT user_id AS serial_id, event_id AS id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT serial_id, id, (sum(CASE WHEN k > 1 AND before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY serial_id ORDER BY id))::BIGINT AS version FROM e")
def version_running(spark, sf_dir):
    """The version of a row after each change of its log."""
    w = Window.partitionBy("serial_id").orderBy("id")
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("serial_id"), F.col("event_id").alias("id"), "event_type")
    changed = (F.row_number().over(w) > 1) & ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))
    return e.withColumn("c", changed.cast("long")).select("serial_id", "id", F.sum("c").over(w).alias("version"))


@query("latest_modification", f"{LOG} SELECT id, serial_id, request_type FROM (SELECT DISTINCT ON (serial_id) * FROM mods WHERE id <= 800 AND persisted AND status = 'COMPLETED' AND request_type IN ('click', 'purchase', 'view') ORDER BY serial_id, id DESC)")
def latest_modification(spark, sf_dir):
    """The newest qualifying change of each serial, up to and with a given id."""
    m = X.changes(spark, sf_dir).where("id <= 800 AND persisted AND status = 'COMPLETED'").where(F.col("request_type").isin("click", "purchase", "view"))
    return m.groupBy("serial_id").agg(F.max_by(F.struct("id", "request_type"), "id").alias("m")).select("m.id", "serial_id", "m.request_type")


@query("last_changes", f"{LOG} SELECT id, status FROM mods ORDER BY id DESC LIMIT 25")
def last_changes(spark, sf_dir):
    return X.changes(spark, sf_dir).select("id", "status").orderBy(F.desc("id")).limit(25)


@query("next_change_id", f"{LOG} SELECT coalesce(max(id), 0) + 1 AS next_id, coalesce(max(CASE WHEN persisted THEN id END), 0) AS max_persisted, count(*) AS n FROM mods")
def next_change_id(spark, sf_dir):
    m = X.changes(spark, sf_dir)
    return m.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"), F.coalesce(F.max(F.when(F.col("persisted"), F.col("id"))), F.lit(0)).alias("max_persisted"), F.count(F.lit(1)).alias("n"))


def parties(spark, sf_dir) -> DataFrame:
    """The change log as three parties see it: some have not finished or never got a change."""
    m = X.changes(spark, sf_dir).where("id <= 600").crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("party"))))
    late = F.col("id") % (F.col("party") + 5) == 0
    return m.where(~((F.col("id") % 31 == 0) & (F.col("party") == 0))).select("party", "id", "serial_id", "request_type", F.when(late | (F.col("id") % 13 == 0), "IN_PROGRESS").otherwise("COMPLETED").alias("status"), (F.col("persisted") & ~late).alias("persisted"))


PARTIES = f"{LOG}, p AS (SELECT party, id, serial_id, request_type, CASE WHEN id % (party + 5) = 0 OR id % 13 = 0 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status, persisted AND id % (party + 5) <> 0 AS persisted FROM mods, (SELECT unnest([0, 1, 2]) AS party) WHERE id <= 600 AND NOT (id % 31 = 0 AND party = 0))"


@query("reconcile_three_parties", f"{PARTIES}, g AS (SELECT id, bool_or(status = 'COMPLETED') AS done, bool_or(persisted) AS kept FROM p GROUP BY id) SELECT p.id, CASE WHEN NOT done THEN 'delete' ELSE 'update' END AS action, done AND kept AS persisted FROM p JOIN g USING (id) WHERE party = 0 AND (NOT done OR p.status <> 'COMPLETED' OR p.persisted <> kept)")
def reconcile_three_parties(spark, sf_dir):
    """What party 0 has to do: changes that nobody finished go, changes that anybody finished are rolled forward."""
    p = parties(spark, sf_dir)
    mine = lambda c: F.max(F.when(F.col("party") == 0, F.col(c)))
    g = p.groupBy("id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("done"), F.bool_or("persisted").alias("kept"), mine("status").alias("status"), mine("persisted").alias("own"))
    return g.where(F.col("status").isNotNull() & (~F.col("done") | (F.col("status") != "COMPLETED") | (F.col("own") != F.col("kept")))).select("id", F.when(F.col("done"), "update").otherwise("delete").alias("action"), (F.col("done") & F.col("kept")).alias("persisted"))


@query("party_consistency", f"{PARTIES} SELECT id, count(DISTINCT request_type) <= 1 AND count(DISTINCT serial_id) <= 1 AS consistent, bool_and(status = 'IN_PROGRESS') AS all_in_progress FROM p GROUP BY id")
def party_consistency(spark, sf_dir):
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    return parties(spark, sf_dir).groupBy("id").agg((same("request_type") & same("serial_id")).alias("consistent"), F.bool_and(F.col("status") == "IN_PROGRESS").alias("all_in_progress"))


@query("completed_spread", f"{PARTIES} SELECT max(m) - min(m) AS spread, min(m) AS freeze, max(m) AS frontier FROM (SELECT party, max(id) AS m FROM p WHERE status = 'COMPLETED' GROUP BY party)")
def completed_spread(spark, sf_dir):
    m = parties(spark, sf_dir).where("status = 'COMPLETED'").groupBy("party").agg(F.max("id").alias("m"))
    return m.agg((F.max("m") - F.min("m")).alias("spread"), F.min("m").alias("freeze"), F.max("m").alias("frontier"))


def versions(spark, sf_dir) -> DataFrame:
    """``serial, g, g_n, s, h``: the greatest graph version and how many, the source's and the store's version."""
    base = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial"))
    k = F.col("serial")
    return base.select("serial", F.when(k % 7 != 0, k % 3 + (k % 11 == 0).cast("int")).alias("g"), F.when(k % 10 == 3, 2).otherwise(1).alias("g_n"), F.when(k % 17 != 0, k % 3).alias("s"), F.when(k % 13 != 0, k % 3 + (k % 19 == 0).cast("int")).alias("h"))


VERSIONS = "WITH v AS (SELECT c_custkey AS serial, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END END AS g, CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END AS g_n, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 3 END AS s, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 3 + CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END END AS h FROM customer)"
_GRAPH = "CASE WHEN g IS NULL THEN 'graph_missing' WHEN g < s THEN 'version_behind' WHEN g > s THEN 'version_ahead' WHEN g_n > 1 THEN 'multi_version' END"
_ROW = "CASE WHEN h IS NULL THEN 'row_missing' WHEN h <> s THEN 'row_mismatch' END"


def version_join(v: DataFrame) -> DataFrame:
    """For each serial whether graph, source and store agree, and if not, why."""
    g, s, h = F.col("g"), F.col("s"), F.col("h")
    graph = F.when(g.isNull(), "graph_missing").when(g < s, "version_behind").when(g > s, "version_ahead").when(F.col("g_n") > 1, "multi_version")
    row = F.when(h.isNull(), "row_missing").when(h != s, "row_mismatch")
    known = s.isNotNull()
    return v.select("serial", (~known).alias("source_missing"), F.when(known, graph).alias("graph_reason"), F.when(known, row).alias("row_reason"), g.isNotNull().alias("in_graph"))


@query("version_join", f"{VERSIONS} SELECT serial, s IS NULL AS source_missing, CASE WHEN s IS NOT NULL THEN {_GRAPH} END AS graph_reason, CASE WHEN s IS NOT NULL THEN {_ROW} END AS row_reason FROM v")
def version_join_query(spark, sf_dir):
    return version_join(versions(spark, sf_dir)).drop("in_graph")


@query("repair_plan", f"{VERSIONS}, j AS (SELECT serial, s, {_GRAPH} AS gr, {_ROW} AS rr, g IS NOT NULL AS in_graph, serial % 4 = 0 AS dead FROM v) SELECT serial, unnest(list_filter([CASE WHEN NOT dead THEN 'graph_replay' END, CASE WHEN dead AND in_graph THEN 'graph_remove' END, CASE WHEN dead AND rr = 'row_mismatch' THEN 'stale_tombstone_row' END, CASE WHEN rr = 'row_missing' THEN 'insert_missing_row' END], lambda x: x IS NOT NULL)) AS action FROM j WHERE s IS NOT NULL AND (gr IS NOT NULL OR rr IS NOT NULL)")
def repair_plan(spark, sf_dir):
    """The actions for serials that disagree; those deleted are taken out of the graph, the others replayed."""
    dead = F.col("serial") % 4 == 0
    bad = version_join(versions(spark, sf_dir)).where(~F.col("source_missing") & (F.col("graph_reason").isNotNull() | F.col("row_reason").isNotNull()))
    actions = F.array(F.when(~dead, "graph_replay"), F.when(dead & F.col("in_graph"), "graph_remove"), F.when(dead & (F.col("row_reason") == "row_mismatch"), "stale_tombstone_row"), F.when(F.col("row_reason") == "row_missing", "insert_missing_row"))
    return bad.select("serial", F.explode(F.filter(actions, lambda x: x.isNotNull())).alias("action"))


def pending() -> Column:
    """Neither claimed nor persisted, and not known to be invalid: an unknown validity counts as pending."""
    return F.col("consumed_batch_id").isNull() & F.col("persisted_at").isNull() & F.coalesce("is_valid", F.lit(True))


@query("pending_requests", f"{QUEUE} SELECT sequence_number FROM ingested WHERE consumed_batch_id IS NULL AND persisted_at IS NULL AND is_valid IS NOT FALSE ORDER BY sequence_number LIMIT 100")
def pending_requests(spark, sf_dir):
    return X.ingested(spark, sf_dir).where(pending()).select("sequence_number").orderBy("sequence_number").limit(100)


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with a dense ``batch`` of at most ``size`` rows, lowest first.

    Rows are range-sorted and numbered task by task; the counts of the tasks give the starts, so no task sees all rows.
    """
    dealt = rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()).persist()
    starts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__s", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n"))
    k = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1 + F.col("__s")
    return dealt.join(F.broadcast(starts.drop("__n")), "__p").withColumn("batch", F.floor(k / size).cast("long")).drop("__p", "__s")


@query("pending_batch_assignment", f"{QUEUE} SELECT sequence_number, (row_number() OVER (ORDER BY sequence_number) - 1) // 64 AS batch FROM ingested WHERE consumed_batch_id IS NULL AND persisted_at IS NULL AND is_valid IS NOT FALSE")
def pending_batch_assignment(spark, sf_dir):
    return batches(X.ingested(spark, sf_dir).where(pending()).select("sequence_number"), "sequence_number", 64)


@query("frontier_skip", f"{QUEUE} SELECT sequence_number, persisted_at IS NULL AND sequence_number <= lpad('500', 40, '0') AS skipped, (SELECT max(sequence_number) FROM ingested WHERE persisted_at IS NOT NULL) AS frontier FROM ingested")
def frontier_skip(spark, sf_dir):
    """Rows up to the fleet's frontier count as persisted; padded numbers compare as text."""
    q = X.ingested(spark, sf_dir)
    top = q.where("persisted_at IS NOT NULL").agg(F.max("sequence_number").alias("frontier"))
    at = F.lpad(F.lit("500"), 40, "0")
    return q.crossJoin(F.broadcast(top)).select("sequence_number", (F.col("persisted_at").isNull() & (F.col("sequence_number") <= at)).alias("skipped"), "frontier")


@query("release_claims", f"{QUEUE} SELECT sequence_number, CASE WHEN persisted_at IS NOT NULL THEN consumed_batch_id END AS consumed_batch_id FROM ingested")
def release_claims(spark, sf_dir):
    return X.ingested(spark, sf_dir).select("sequence_number", F.when(F.col("persisted_at").isNotNull(), F.col("consumed_batch_id")).alias("consumed_batch_id"))


@query("claim_batch", f"{QUEUE}, t AS (SELECT sequence_number FROM ingested WHERE consumed_batch_id IS NULL AND persisted_at IS NULL AND is_valid IS NOT FALSE ORDER BY 1 LIMIT 32) SELECT sequence_number, coalesce(consumed_batch_id, CASE WHEN sequence_number IN (SELECT * FROM t) THEN 7 END) AS consumed_batch_id FROM ingested")
def claim_batch(spark, sf_dir):
    q = X.ingested(spark, sf_dir)
    mine = q.where(pending()).select("sequence_number").orderBy("sequence_number").limit(32).withColumn("claim", F.lit(7).cast("long"))
    return q.join(F.broadcast(mine), "sequence_number", "left").select("sequence_number", F.coalesce("consumed_batch_id", "claim").alias("consumed_batch_id"))


@query("ingest_dedupe", "SELECT lpad((event_id % 700)::VARCHAR, 40, '0') AS sequence_number, min(event_id) AS first_event FROM events GROUP BY 1")
def ingest_dedupe(spark, sf_dir):
    """The first arrival of each sequence number; digits of any length are padded to 40."""
    n = F.lpad((F.col("event_id") % 700).cast("string"), 40, "0").alias("sequence_number")
    return X.table(spark, sf_dir, "events").groupBy(n).agg(F.min("event_id").alias("first_event"))


@query("first_in_batch", "WITH e AS (SELECT event_id, event_id // 50 AS batch, user_id AS serial FROM events) SELECT event_id, batch, serial, row_number() OVER (PARTITION BY batch, serial ORDER BY event_id) > 1 AS duplicate FROM e")
def first_in_batch(spark, sf_dir):
    """A serial may come once in a batch: the first request wins, later ones are errors."""
    e = X.table(spark, sf_dir, "events").select("event_id", F.expr("event_id DIV 50").alias("batch"), F.col("user_id").alias("serial"))
    return e.withColumn("duplicate", F.row_number().over(Window.partitionBy("batch", "serial").orderBy("event_id")) > 1)


@query("poison_classifier", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'malformed' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown_type' WHEN event_id % 8 = 0 THEN 'missing_key' ELSE 'ok' END AS class FROM events")
def poison_classifier(spark, sf_dir):
    """Messages that parse, know their type and carry a key; the others go to quarantine by reason."""
    e = X.table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit('{"type": '), "event_type")).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("event_id") % 8 != 0, F.col("event_id").cast("string")).alias("key"))))
    p = F.from_json(body, "type string, key string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = e.select("event_id", p.alias("p"))
    kind = F.when(F.col("p._bad").isNotNull(), "malformed").when(~F.col("p.type").isin("click", "view", "purchase"), "unknown_type").when(F.col("p.key").isNull(), "missing_key").otherwise("ok")
    return rows.select("event_id", kind.alias("class"))


@query("envelope_explode", "SELECT event_id || ':' || i AS request_id, event_type FROM events, (SELECT unnest([0, 1, 2]) AS i) WHERE i < event_id % 4")
def envelope_explode(spark, sf_dir):
    """A message holds several requests; each gets the id ``message:index``."""
    e = X.table(spark, sf_dir, "events").where("event_id % 4 > 0")
    body = F.to_json(F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int")), lambda i: F.struct(F.col("event_type").alias("t"))))
    each = e.select("event_id", F.posexplode(F.from_json(body, "array<struct<t:string>>")))
    return each.select(F.concat_ws(":", "event_id", "pos").alias("request_id"), F.col("col.t").alias("event_type"))


@query("valid_entries", "SELECT event_id, bool_and(event_id % (p + 5) <> 0) AS valid FROM events, (SELECT unnest([0, 1, 2]) AS p) GROUP BY event_id HAVING bool_and(event_id % (p + 5) <> 0)")
def valid_entries(spark, sf_dir):
    """Entries that all three parties find valid."""
    e = X.table(spark, sf_dir, "events").select("event_id").crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("p"))))
    return e.groupBy("event_id").agg(F.bool_and(F.col("event_id") % (F.col("p") + 5) != 0).alias("valid")).where("valid")


@query("overlay_load", "WITH s AS (SELECT o_orderkey AS id, 0 AS v FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS id, 1 AS v FROM orders WHERE o_orderdate >= DATE '1997-01-01') SELECT id, max(v)::BIGINT AS v FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY id")
def overlay_load(spark, sf_dir):
    """A snapshot, and over it the rows modified since shortly before it."""
    o = X.table(spark, sf_dir, "orders")
    snap = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("v"))
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("date")).select(F.col("o_orderkey").alias("id"), F.lit(1).cast("long").alias("v"))
    return snap.unionByName(new).groupBy("id").agg(F.max("v").alias("v"))


@query("snapshot_discovery", "WITH f AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'junk' || event_id ELSE (1700000000 + (event_id * 7919) % 10007) || '_' || (event_id % 64) || '_' || event_id END AS name FROM events) SELECT string_split(name, '_')[1]::BIGINT AS ts, string_split(name, '_')[2]::BIGINT AS chunk, string_split(name, '_')[3]::BIGINT AS last_id FROM f WHERE len(string_split(name, '_')) = 3 ORDER BY ts DESC, last_id DESC LIMIT 1")
def snapshot_discovery(spark, sf_dir):
    """The newest of the files named ``unix_chunk_lastid``; other names are passed over."""
    k = F.col("event_id")
    name = F.when(k % 10 == 0, F.concat(F.lit("junk"), k)).otherwise(F.concat_ws("_", 1700000000 + (k * 7919) % 10007, k % 64, k))
    p = F.split(F.col("name"), "_")
    f = X.table(spark, sf_dir, "events").select(name.alias("name")).where(F.size(p) == 3).select(F.struct(p[0].cast("long").alias("ts"), p[2].cast("long").alias("last_id"), p[1].cast("long").alias("chunk")).alias("f"))
    return f.agg(F.max("f").alias("f")).select("f.ts", "f.chunk", "f.last_id")


@query("dynamic_batch_sizes", "WITH RECURSIVE b(k, first, size) AS (SELECT 0, 1::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, first + size, least((first + size - 1) // (16 * 2 - 1) + 1, 400) FROM b WHERE first + size <= 3000) SELECT k::BIGINT AS k, first, size FROM b")
def dynamic_batch_sizes(spark, sf_dir):
    """Batches that grow with the index: last id div (M r - 1) + 1, capped. A batch's size needs the one before."""
    rows, first, size, k = [], 1, 1, 0
    while True:
        rows.append((k, first, size))
        if first + size > 3000:
            break
        first, k = first + size, k + 1
        size = min((first - 1) // (16 * 2 - 1) + 1, 400)
    return spark.createDataFrame(rows, "k long, first long, size long")


@query("batch_ids_without_exclusions", "SELECT c_custkey AS serial, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS batch FROM customer WHERE c_custkey % 6 <> 0")
def batch_ids_without_exclusions(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial"))
    gone = c.where("serial % 6 = 0")
    return batches(c.join(gone, "serial", "left_anti"), "serial", 50)


@query("retention_keep", f"{QUEUE} SELECT count(*) AS n, count(*) FILTER (NOT (received_at < TIMESTAMP '{START}' + INTERVAL {RETENTION_DAYS} DAY AND persisted_at IS NOT NULL)) AS kept FROM ingested")
def retention_keep(spark, sf_dir):
    """Old rows go only if they are persisted; the same predicate counts them in a dry run."""
    old = (F.col("received_at") < F.expr(f"TIMESTAMP_NTZ '{START} 00:00:00' + INTERVAL {RETENTION_DAYS} DAYS")) & F.col("persisted_at").isNotNull()
    return X.ingested(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(~old).alias("kept"))


@query("truncate_tail", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 1000")
def truncate_tail(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").where("o_orderkey <= 1000").select("o_orderkey")


def catalogue(spark, sf_dir) -> DataFrame:
    """A checkpoint catalogue of a few hundred rows."""
    c = X.table(spark, sf_dir, "customer").where("c_custkey <= 300").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    return c.select("id", F.concat(F.lit("ck"), k % 97).alias("hash"), (k % 10 == 0).alias("is_archival"), (k % 8 == 1).alias("is_deleted"), F.floor((300 - k) / 4).cast("long").alias("age_days"))


CATALOGUE = "WITH c AS (SELECT c_custkey AS id, 'ck' || (c_custkey % 97) AS hash, c_custkey % 10 = 0 AS is_archival, c_custkey % 8 = 1 AS is_deleted, (300 - c_custkey) // 4 AS age_days FROM customer WHERE c_custkey <= 300)"


@query("checkpoint_prune", f"{CATALOGUE}, r AS (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS rank, count(*) OVER () AS total FROM c) SELECT id FROM r WHERE id <> 300 AND id < 290 AND NOT is_deleted AND NOT is_archival AND rank >= 5 AND (age_days >= 60 OR (total - 1 - rank) % 4 <> 0)")
def checkpoint_prune(spark, sf_dir):
    """Checkpoints to delete: archival and recent ones stay, ancient ones go, of the others every fourth stays.

    The catalogue is a small table of the service itself, so one window over all of it is fine.
    """
    r = catalogue(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("id"))) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return r.where("id <> 300 AND id < 290 AND NOT is_deleted AND NOT is_archival AND rank >= 5 AND (age_days >= 60 OR (total - 1 - rank) % 4 <> 0)").select("id")


@query("checkpoint_common", f"{CATALOGUE} SELECT max(id) AS id FROM c WHERE NOT is_deleted AND hash IN (SELECT hash FROM c WHERE id % 3 = 1) AND hash IN (SELECT hash FROM c WHERE id % 3 = 2)")
def checkpoint_common(spark, sf_dir):
    """The newest live checkpoint that both peers have as well."""
    c = catalogue(spark, sf_dir)
    peers = [c.where(f"id % 3 = {k}").select("hash") for k in (1, 2)]
    return c.where("NOT is_deleted").join(peers[0], "hash", "left_semi").join(peers[1], "hash", "left_semi").agg(F.max("id").alias("id"))


@query("wal_prune", f"{CATALOGUE} SELECT id FROM c WHERE id > (SELECT min(id) + 100 FROM c WHERE NOT is_deleted)")
def wal_prune(spark, sf_dir):
    c = catalogue(spark, sf_dir)
    low = c.where("NOT is_deleted").agg((F.min("id") + 100).alias("low"))
    return c.crossJoin(F.broadcast(low)).where("id > low").select("id")


@query("state_get", "SELECT coalesce((SELECT max(n_nationkey) FROM nation WHERE n_name = 'NOWHERE'), 0)::BIGINT AS value, coalesce(max(CASE WHEN n_name = 'FRANCE' THEN n_nationkey END), 0)::BIGINT AS other FROM nation")
def state_get(spark, sf_dir):
    """Values of a key/value state, with a default for a missing key."""
    at = lambda name: F.coalesce(F.max(F.when(F.col("n_name") == name, F.col("n_nationkey"))), F.lit(0)).cast("long")
    return X.table(spark, sf_dir, "nation").agg(at("NOWHERE").alias("value"), at("FRANCE").alias("other"))


@query("bulk_update", "WITH u AS (SELECT unnest(range(1, 200)) AS id) SELECT c_custkey AS id, CASE WHEN u.id IS NOT NULL THEN 'done' ELSE 'open' END AS status FROM customer LEFT JOIN u ON c_custkey = u.id")
def bulk_update(spark, sf_dir):
    """An update from parallel arrays."""
    u = spark.range(1).select(F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(199)).alias("id"), F.array_repeat(F.lit("done"), 199).alias("new"))))
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(F.broadcast(u), "id", "left").select("id", F.coalesce("new", F.lit("open")).alias("status"))


@query("range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_scan(spark, sf_dir):
    """A half-open range: row groups outside it are never read, nor are other columns."""
    return X.table(spark, sf_dir, "orders").where("o_orderkey >= 100 AND o_orderkey < 900").select("o_orderkey", "o_custkey")


@query("partitioned_scan", "WITH m AS (SELECT (max(o_orderkey) + 7) // 8 AS w FROM orders) SELECT (o_orderkey - 1) // w AS part, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders, m GROUP BY 1")
def partitioned_scan(spark, sf_dir):
    """Eight equal id ranges, as parallel readers would get them."""
    o = X.table(spark, sf_dir, "orders")
    w = o.agg(F.expr("(max(o_orderkey) + 7) DIV 8").alias("w"))
    return o.crossJoin(F.broadcast(w)).groupBy(F.expr("(o_orderkey - 1) DIV w").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("log_range", f"{LOG} SELECT id, request_type FROM mods WHERE id > 100 AND id <= 400")
def log_range(spark, sf_dir):
    """The log after one mark and up to another."""
    return X.changes(spark, sf_dir).where("id > 100 AND id <= 400").select("id", "request_type")


@query("recent_serials", "SELECT vec_id + 1 AS serial FROM embeddings ORDER BY serial DESC LIMIT 30")
def recent_serials(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("serial")).orderBy(F.desc("serial")).limit(30)


@query("deletions_list", "SELECT c_custkey AS serial FROM customer WHERE c_custkey <= 200 AND c_custkey % 9 = 4")
def deletions_list(spark, sf_dir):
    """Deleted serials, from a JSON object with a list, that are rows of the store."""
    text = F.to_json(F.struct(F.filter(F.sequence(F.lit(1), F.lit(200)), lambda x: x % 9 == 4).alias("deleted_serial_ids")))
    ids = spark.range(1).select(F.explode(F.from_json(text, "deleted_serial_ids array<bigint>")["deleted_serial_ids"]).alias("serial"))
    return X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial")).join(F.broadcast(ids), "serial", "left_semi")
