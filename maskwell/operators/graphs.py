"""Neighbour graphs as edge tables: liveness, change replay, consistency checks, differences, reachability.

The graph is ``nodes(layer, serial, version, seq_no)`` and ``edges(layer, src, dst, nbhd_seq)``. An edge is live if its
target exists and was written no later than the neighbourhood that names it. Checks return their violations, so an empty
result is a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import fixtures as X

DEGREE, LAYER_BASE = 6, 8
#: The range of ids that the SQL below states. Its literals hold for tables up to it; beyond, the queries follow the table.
LEAST_IDS = 1500


def id_range(spark, sf_dir) -> int:
    """One more than the greatest id, and ``LEAST_IDS`` at least."""
    most = X.table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return max(LEAST_IDS, (most or 0) + 1)


def nodes(spark, sf_dir) -> DataFrame:
    """Customers as nodes: in layer 0 all, in layer 1 every eighth, in layer 2 every 64th."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial"))
    k = F.col("serial")
    layers = F.filter(F.array(F.lit(0), F.when(k % LAYER_BASE == 0, 1), F.when(k % LAYER_BASE**2 == 0, 2)), lambda x: x.isNotNull())
    return c.select(F.explode(layers.cast("array<bigint>")).alias("layer"), "serial", (k % 3).alias("version"), (k * 7 % 1000).alias("seq_no"))


def edges(spark, sf_dir, salt: int = 0) -> DataFrame:
    """Six pseudo-random targets for each node within its layer, some of them missing, stale, repeated or the node itself."""
    n = nodes(spark, sf_dir).where("serial % 50 <> 7")
    e = n.select("layer", F.col("serial").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(DEGREE)).cast("array<bigint>")).alias("j"))
    step = F.expr("CASE layer WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 64 END").cast("long")
    dst = ((F.floor(F.col("src") / step) * 31 + F.col("j") * (17 + salt)) % F.floor(F.lit(id_range(spark, sf_dir) + 40) / step) + 1).cast("long") * step
    return e.select("layer", "src", dst.alias("dst"), (F.col("src") * 7 % 1000 + 300).alias("nbhd_seq"))


GRAPH = f"""nodes AS (
  SELECT layer, serial, serial % 3 AS version, serial * 7 % 1000 AS seq_no FROM (SELECT c_custkey AS serial, unnest(list_filter([0, CASE WHEN c_custkey % 8 = 0 THEN 1 END, CASE WHEN c_custkey % 64 = 0 THEN 2 END], lambda x: x IS NOT NULL))::BIGINT AS layer FROM customer WHERE c_custkey <= 1500)),
  st AS (SELECT *, CASE layer WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 64 END AS step FROM nodes WHERE serial % 50 <> 7),
  edges AS (SELECT layer, serial AS src, ((serial // step * 31 + j * 17) % (1540 // step) + 1)::BIGINT * step AS dst, serial * 7 % 1000 + 300 AS nbhd_seq FROM st, (SELECT unnest(range(1, 7)) AS j)),
  other AS (SELECT layer, serial AS src, ((serial // step * 31 + j * (17 + CASE WHEN serial % 3 = 0 THEN 1 ELSE 0 END)) % (1540 // step) + 1)::BIGINT * step AS dst FROM st, (SELECT unnest(range(1, 7)) AS j))"""
WITH = f"WITH {GRAPH} "


def other_edges(spark, sf_dir) -> DataFrame:
    """A second graph that differs from the first in every third node."""
    a, b = edges(spark, sf_dir).where("src % 3 <> 0"), edges(spark, sf_dir, 1).where("src % 3 = 0")
    return a.unionByName(b).select("layer", "src", "dst")


def live(e: DataFrame, n: DataFrame) -> DataFrame:
    clock = n.select("layer", F.col("serial").alias("dst"), "seq_no")
    return e.join(clock, ["layer", "dst"]).where("seq_no <= nbhd_seq").select("layer", "src", "dst")


@query("active_links", f"{WITH} SELECT e.layer, src, dst FROM edges e JOIN nodes n ON n.layer = e.layer AND n.serial = e.dst WHERE n.seq_no <= e.nbhd_seq")
def active_links(spark, sf_dir):
    return live(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("check_1a_orphans", f"{WITH} SELECT layer, serial FROM nodes WHERE serial NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 90 <> 0)")
def check_1a(spark, sf_dir):
    """Nodes without a row in the store."""
    rows = X.table(spark, sf_dir, "customer").where("c_custkey % 90 <> 0").select(F.col("c_custkey").alias("serial"))
    return nodes(spark, sf_dir).select("layer", "serial").join(rows, "serial", "left_anti").select("layer", "serial")


@query("check_1b_coverage", f"{WITH}, u AS (SELECT c_custkey AS serial FROM customer WHERE c_custkey <= 1550 EXCEPT SELECT serial FROM nodes), x AS (SELECT c_custkey AS serial FROM customer WHERE c_custkey BETWEEN 1490 AND 1545) SELECT serial, 'not_excluded' AS why FROM (SELECT * FROM u EXCEPT SELECT * FROM x) UNION ALL SELECT serial, 'excluded_but_present' FROM (SELECT * FROM x EXCEPT SELECT * FROM u)")
def check_1b(spark, sf_dir):
    """Rows that aren't in the graph must be exactly the excluded ones."""
    rows, n = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial")), id_range(spark, sf_dir)
    missing = rows.join(nodes(spark, sf_dir).select("serial").distinct(), "serial", "left_anti")
    excluded = rows.where(F.col("serial").between(n - 10, n + 45))
    return missing.join(excluded, "serial", "left_anti").withColumn("why", F.lit("not_excluded")).union(excluded.join(missing, "serial", "left_anti").withColumn("why", F.lit("excluded_but_present")))


@query("check_1c_layers", f"{WITH} SELECT a.layer, a.serial FROM nodes a LEFT JOIN nodes b ON b.layer = a.layer - 1 AND b.serial = a.serial AND b.serial % 128 <> 0 WHERE a.layer > 0 AND b.serial IS NULL")
def check_1c(spark, sf_dir):
    """Nodes of a layer that the layer below doesn't have."""
    n = nodes(spark, sf_dir).select("layer", "serial")
    below = n.where("serial % 128 <> 0").withColumn("layer", F.col("layer") + 1)
    return n.where("layer > 0").join(below, ["layer", "serial"], "left_anti")


@query("check_1d_neighbours", f"{WITH} SELECT e.layer, src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.layer = e.layer AND n.serial = e.dst)")
def check_1d(spark, sf_dir):
    return edges(spark, sf_dir).select("layer", "src", "dst").join(nodes(spark, sf_dir).select("layer", F.col("serial").alias("dst")), ["layer", "dst"], "left_anti").select("layer", "src", "dst")


@query("check_1e_self_loops", f"{WITH} SELECT layer, src FROM edges WHERE src = dst")
def check_1e(spark, sf_dir):
    return edges(spark, sf_dir).where("src = dst").select("layer", "src")


FAULTY = "faulty AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE src % 70 = 3)"


def faulty_edges(spark, sf_dir) -> DataFrame:
    """The graph with every neighbour of some nodes listed twice."""
    e = edges(spark, sf_dir)
    return e.union(e.where("src % 70 = 3"))


@query("check_1f_duplicates", f"{WITH}, {FAULTY} SELECT layer, src, dst, count(*) AS n FROM faulty GROUP BY ALL HAVING count(*) > 1")
def check_1f(spark, sf_dir):
    return faulty_edges(spark, sf_dir).groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("check_1g_degree", f"{WITH}, {FAULTY} SELECT layer, src AS serial, count(*) AS n FROM faulty GROUP BY ALL HAVING count(*) > CASE WHEN layer = 0 THEN 8 ELSE 6 END")
def check_1g(spark, sf_dir):
    """Nodes whose own neighbour list is longer than their layer's limit."""
    return faulty_edges(spark, sf_dir).groupBy("layer", F.col("src").alias("serial")).agg(F.count(F.lit(1)).alias("n")).where("n > CASE WHEN layer = 0 THEN 8 ELSE 6 END")


@query("check_1h_entry_points", f"{WITH}, ep AS (SELECT unnest([64, 128, 63, 1536]) AS serial, 2 AS layer) SELECT serial::BIGINT AS serial FROM ep WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.layer = ep.layer AND n.serial = ep.serial)")
def check_1h(spark, sf_dir):
    ep = spark.createDataFrame([(s, 2) for s in (64, 128, 63, 1536)], "serial long, layer long")
    return ep.join(nodes(spark, sf_dir).select("layer", "serial"), ["layer", "serial"], "left_anti").select("serial")


@query("check_1i_same_ids", f"{WITH}, l AS (SELECT serial FROM nodes WHERE layer = 0 AND serial % 40 <> 1), r AS (SELECT serial FROM nodes WHERE layer = 0 AND serial % 40 <> 2) SELECT serial, 'left' AS only_in FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT serial, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)")
def check_1i(spark, sf_dir):
    """Serials that only one eye's graph has; one aggregate tells for both sides."""
    n = nodes(spark, sf_dir).where("layer = 0").select("serial")
    both = n.where("serial % 40 <> 1").withColumn("eye", F.lit("left")).union(n.where("serial % 40 <> 2").withColumn("eye", F.lit("right")))
    return both.groupBy("serial").agg(F.count_distinct("eye").alias("n"), F.min("eye").alias("only_in")).where("n = 1").select("serial", "only_in")


@query("check_1j_layer_sizes", f"{WITH}, s AS (SELECT layer, count(*) AS n FROM nodes GROUP BY layer), t AS (SELECT max(n) AS total FROM s) SELECT layer, n, total * pow(0.125, layer) AS expected, abs(n - total * pow(0.125, layer)) <= 3 * sqrt(total * pow(0.125, layer) * (1 - pow(0.125, layer))) AS ok FROM s, t")
def check_1j(spark, sf_dir):
    """Layer sizes within three standard deviations of a binomial."""
    s = nodes(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    p = F.pow(F.lit(0.125), F.col("layer"))
    rows = s.crossJoin(F.broadcast(s.agg(F.max("n").alias("total")))).withColumn("expected", F.col("total") * p)
    return rows.select("layer", "n", "expected", (F.abs(F.col("n") - F.col("expected")) <= 3 * F.sqrt(F.col("expected") * (1 - p))).alias("ok"))


@query("check_2_watermarks", f"{WITH}, l AS (SELECT max(serial) AS m FROM nodes WHERE layer = 0 AND serial % 40 <> 1), r AS (SELECT max(serial) AS m FROM nodes WHERE layer = 0 AND serial % 40 <> (SELECT max(c_custkey) % 40 FROM customer)), mark AS (SELECT max(c_custkey) AS m FROM customer WHERE c_custkey % 50 <> 49) SELECT mark.m AS mark, (SELECT max(c_custkey) FROM customer) AS max_id, l.m AS left_max, r.m AS right_max, mark.m = (SELECT max(c_custkey) FROM customer) AS mark_ok, l.m = r.m AS eyes_equal FROM l, r, mark")
def check_2(spark, sf_dir):
    """The stored mark against the greatest id, and the left graph's greatest id against the right one's."""
    c = X.table(spark, sf_dir, "customer").agg(F.max(F.when(F.col("c_custkey") % 50 != 49, F.col("c_custkey"))).alias("mark"), F.max("c_custkey").alias("max_id"))
    rows = nodes(spark, sf_dir).where("layer = 0").crossJoin(F.broadcast(c))  # c is one row
    greatest = rows.groupBy("mark", "max_id").agg(F.max(F.expr("CASE WHEN serial % 40 <> 1 THEN serial END")).alias("left_max"), F.max(F.expr("CASE WHEN serial % 40 <> max_id % 40 THEN serial END")).alias("right_max"))
    return greatest.withColumns({"mark_ok": F.col("mark") == F.col("max_id"), "eyes_equal": F.col("left_max") == F.col("right_max")})


@query("check_3c_equal_rows", "SELECT a.c_custkey AS id FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE a.c_custkey % 10 = 0 AND (CASE WHEN b.c_custkey % 70 = 0 THEN NULL ELSE b.c_name END) IS DISTINCT FROM a.c_name")
def check_3c(spark, sf_dir):
    """Sampled rows that differ between two stores; nulls compare as values."""
    a = X.table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), "c_name")
    b = a.select("id", F.when(F.col("id") % 70 != 0, F.col("c_name")).alias("b_name"))
    return a.join(b, "id").where(~F.col("c_name").eqNullSafe(F.col("b_name"))).select("id")


def neighbourhoods(spark, sf_dir) -> DataFrame:
    """``layer, src, inter, uni, left_only, right_only`` from one grouped pass over both edge lists."""
    a = edges(spark, sf_dir).select("layer", "src", "dst", F.lit(1).alias("side"))
    b = other_edges(spark, sf_dir).select("layer", "src", "dst", F.lit(2).alias("side"))
    per = a.union(b).groupBy("layer", "src", "dst").agg(F.bool_or(F.col("side") == 1).alias("l"), F.bool_or(F.col("side") == 2).alias("r"))
    only = lambda x, y: F.sort_array(F.collect_list(F.when(F.col(x) & ~F.col(y), F.col("dst"))))
    return per.groupBy("layer", "src").agg(F.count_if(F.col("l") & F.col("r")).alias("inter"), F.count(F.lit(1)).alias("uni"), only("l", "r").alias("left_only"), only("r", "l").alias("right_only"))


DIFF = f"{GRAPH}, per AS (SELECT layer, src, dst, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT layer, src, dst, 1 AS s FROM edges UNION ALL SELECT layer, src, dst, 2 FROM other) GROUP BY ALL), nb AS (SELECT layer, src, count(*) FILTER (l AND r) AS inter, count(*) AS uni, coalesce(list(dst ORDER BY dst) FILTER (l AND NOT r), []) AS left_only, coalesce(list(dst ORDER BY dst) FILTER (r AND NOT l), []) AS right_only FROM per GROUP BY layer, src)"


@query("jaccard_layer", f"WITH {DIFF} SELECT layer, sum(inter)::BIGINT AS inter, sum(uni)::BIGINT AS uni, sum(inter)::DOUBLE / sum(uni) AS jaccard FROM nb GROUP BY layer")
def jaccard_layer(spark, sf_dir):
    n = neighbourhoods(spark, sf_dir).groupBy("layer").agg(F.sum("inter").alias("inter"), F.sum("uni").alias("uni"))
    return n.withColumn("jaccard", F.when(F.col("uni") == 0, 1.0).otherwise(F.col("inter").cast("double") / F.col("uni")))


@query("jaccard_top_n", f"WITH {DIFF} SELECT layer, src, inter::DOUBLE / uni AS jaccard FROM nb QUALIFY row_number() OVER (PARTITION BY layer ORDER BY inter::DOUBLE / uni, src) <= 5")
def jaccard_top_n(spark, sf_dir):
    """The five most dissimilar nodes of each layer."""
    n = neighbourhoods(spark, sf_dir).select("layer", "src", (F.col("inter").cast("double") / F.col("uni")).alias("jaccard"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("jaccard", "src"))).where("k <= 5").drop("k")


@query("graph_explicit_diff", f"WITH {DIFF} SELECT layer, src, left_only, right_only FROM nb WHERE inter <> uni")
def graph_explicit_diff(spark, sf_dir):
    return neighbourhoods(spark, sf_dir).where("inter <> uni").select("layer", "src", "left_only", "right_only")


@query("node_equivalence", f"{WITH} SELECT layer, serial, CASE WHEN serial % 25 = 3 THEN 'left' ELSE 'right' END AS only_in FROM nodes WHERE (serial % 25 = 3) <> (serial % 35 = 4)")
def node_equivalence(spark, sf_dir):
    n = nodes(spark, sf_dir).select("layer", "serial")
    a, b = n.where("serial % 35 <> 4"), n.where("serial % 25 <> 3")
    return a.join(b, ["layer", "serial"], "left_anti").withColumn("only_in", F.lit("left")).union(b.join(a, ["layer", "serial"], "left_anti").withColumn("only_in", F.lit("right")))


def node_code(serial: str):
    """A 32-bit code of a node, for distances between nodes of the fixture."""
    return F.col(serial) * 2654435761 % 4294967296


def beyond_nearest(e: DataFrame, distance, limit: int, keep: int) -> DataFrame:
    """The edges that go when neighbourhoods of more than ``limit`` keep the ``keep`` neighbours nearest to their base node.

    Groups are cut to candidates inside the window; a neighbourhood is bounded by its degree.
    """
    w = Window.partitionBy("layer", "src")
    ranked = e.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy(distance, "dst"))})
    return ranked.where((F.col("n") > limit) & (F.col("k") > keep)).select("layer", "src", "dst")


@query("compaction", f"{WITH}, e AS (SELECT layer, src, dst FROM edges UNION SELECT layer, src, dst FROM other), k AS (SELECT *, count(*) OVER (PARTITION BY layer, src) AS n, row_number() OVER (PARTITION BY layer, src ORDER BY bit_count(xor(src * 2654435761 % 4294967296, dst * 2654435761 % 4294967296)), dst) AS k FROM e) SELECT layer, src, dst FROM k WHERE n > 6 AND k > 6")
def compaction(spark, sf_dir):
    """Neighbourhoods over the limit keep the nearest of their neighbours, by the distance to the base node."""
    e = edges(spark, sf_dir).select("layer", "src", "dst").union(other_edges(spark, sf_dir)).distinct()
    return beyond_nearest(e, F.bit_count(node_code("src").bitwiseXOR(node_code("dst"))), DEGREE, DEGREE)


@query("degree_summary", f"{WITH}, d AS (SELECT layer, dst, count(*) AS n FROM edges GROUP BY ALL) SELECT layer, min(n) AS low, avg(n) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, max(n) AS high FROM d GROUP BY layer")
def degree_summary(spark, sf_dir):
    """The median is the upper one. Degrees are counted first, so what is walked is a histogram, not the nodes."""
    d = edges(spark, sf_dir).groupBy("layer", "dst").agg(F.count(F.lit(1)).alias("deg")).groupBy("layer", "deg").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("layer").orderBy("deg")
    h = d.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("layer")))
    median = F.min(F.when(F.col("upto") > F.expr("total DIV 2"), F.col("deg")))
    return h.groupBy("layer").agg(F.min("deg").alias("low"), (F.sum(F.col("deg") * F.col("n")) / F.sum("n")).alias("mean"), median.alias("upper_median"), F.max("deg").alias("high"))


@query("degree_histogram", f"{WITH} SELECT layer, n AS degree, count(*) AS nodes FROM (SELECT layer, dst, count(*) AS n FROM edges GROUP BY ALL) GROUP BY ALL")
def degree_histogram(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("layer", "dst").agg(F.count(F.lit(1)).alias("degree")).groupBy("layer", "degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("bucket_matrix", f"{WITH} SELECT layer, src // 200 AS from_bucket, dst // 200 AS to_bucket, count(*) AS n FROM edges GROUP BY ALL")
def bucket_matrix(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("layer", F.expr("src DIV 200").alias("from_bucket"), F.expr("dst DIV 200").alias("to_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("id_migration", f"{WITH} SELECT layer, src * 10 AS src, dst * 10 AS dst FROM edges WHERE src % 9 <> 0 AND dst % 9 <> 0 AND dst IN (SELECT c_custkey FROM customer)")
def id_migration(spark, sf_dir):
    """Edges under new ids; ids without a new one drop out."""
    ids = X.table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") * 10).alias("new"))
    e = edges(spark, sf_dir).join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "t"), "dst")
    return e.select("layer", F.col("s").alias("src"), F.col("t").alias("dst"))


def hops(e: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """``serial, hop``: the fewest steps from any source along ``e(src, dst)``; a step is one join on the new frontier."""
    seen = frontier = X.cut(sources.select("serial", F.lit(0).cast("long").alias("hop")))
    e = X.cut(e.select("src", "dst").distinct())
    for hop in range(1, most + 1):
        step = frontier.select(F.col("serial").alias("src")).join(e, "src").select(F.col("dst").alias("serial")).distinct()
        frontier = X.cut(step.join(seen.select("serial"), "serial", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query("bfs_hops", f"WITH RECURSIVE {GRAPH}, b(serial, hop) AS (SELECT 64::BIGINT, 0::BIGINT UNION SELECT e.dst, hop + 1 FROM b JOIN edges e ON e.layer = 0 AND e.src = b.serial WHERE hop < 12 AND e.dst <= 1500) SELECT serial, min(hop) AS hop FROM b GROUP BY serial")
def bfs_hops(spark, sf_dir):
    return hops(edges(spark, sf_dir).where((F.col("layer") == 0) & (F.col("dst") <= id_range(spark, sf_dir))), spark.createDataFrame([(64,)], "serial long"))


def strong_components(e: DataFrame) -> DataFrame:
    """``serial, component`` (the least serial): nodes that reach each other.

    The greatest serial that reaches a node and the greatest that it reaches are propagated; where both agree, the node
    is in that serial's component and leaves. Each pass settles at least one component of every part that is left.
    """
    left, done = X.cut(e.select("src", "dst").where("src <> dst").distinct()), None
    todo = X.cut(e.select(F.col("src").alias("serial")).union(e.select("dst")).distinct())

    def spread(a: str, b: str) -> DataFrame:
        """For each node the greatest serial among itself and what leads to it along a -> b."""
        label = X.cut(todo.select("serial", F.col("serial").alias("m"), F.lit(True).alias("moved")))
        while True:
            news = label.where("moved").join(left.select(F.col(a).alias("serial"), F.col(b).alias("to")), "serial").groupBy(F.col("to").alias("serial")).agg(F.max("m").alias("n"))
            label = X.cut(label.join(news, "serial", "left").select("serial", F.greatest("m", F.coalesce("n", "m")).alias("m"), F.coalesce(F.col("n") > F.col("m"), F.lit(False)).alias("moved")))
            if label.where("moved").isEmpty():
                return label.select("serial", "m")

    while not todo.isEmpty():
        both = spread("src", "dst").join(spread("dst", "src").withColumnRenamed("m", "w"), "serial")
        found = X.cut(both.where("m = w").select("serial", "m"))
        done = found if done is None else done.unionByName(found)
        todo = X.cut(todo.join(found.select("serial"), "serial", "left_anti"))
        left = X.cut(left.join(todo.toDF("src"), "src", "left_semi").join(todo.toDF("dst"), "dst", "left_semi"))
    least = done.groupBy("m").agg(F.min("serial").alias("component"))
    return done.join(least, "m").select("serial", "component")


@query("scc", f"WITH RECURSIVE {GRAPH}, e2 AS (SELECT DISTINCT src, dst FROM edges WHERE layer = 2), r(a, b) AS (SELECT src, dst FROM e2 UNION SELECT r.a, e2.dst FROM r JOIN e2 ON r.b = e2.src), n AS (SELECT src AS serial FROM e2 UNION SELECT dst FROM e2) SELECT n.serial, least(n.serial, coalesce(min(r.b), n.serial)) AS component FROM n LEFT JOIN r ON r.a = n.serial AND EXISTS (SELECT 1 FROM r x WHERE x.a = r.b AND x.b = n.serial) GROUP BY n.serial")
def scc(spark, sf_dir):
    return strong_components(edges(spark, sf_dir).where("layer = 2"))


def apply_mutations(wal: DataFrame) -> DataFrame:
    """Fold a write-ahead log into ``eye, layer, src, dst, nbhd_seq``.

    ``wal`` has ``eye, seq_no, as_of, op, base, layer, neighbors, side``, one row an operation. Records apply in order of
    seq_no; within one, node operations come first. References count if their node was minted in the record or
    existed unchanged at its as_of. A neighbourhood drops stale links when it is edited, then takes the record's stamp.
    When a node was minted and removed follows from its own node operations alone. So each reference gets, from its node's
    timeline, whether it counts and the seq_no from which it is stale; the neighbourhoods of a node then fold by themselves.
    """
    wal = X.cut(wal.select("eye", "seq_no", "as_of", "op", "base", "layer", "neighbors", "side").withColumn("pos", F.monotonically_increasing_id()))
    node_ops = wal.where("op IN ('add_node', 'remove_node')")
    edge_ops = wal.where("op IN ('add_edges', 'remove_edges')")
    # -1 is the base itself
    named = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("base").alias("node"))), F.transform("neighbors", lambda z, k: F.struct(k.alias("at"), z.alias("node"))))
    uses = edge_ops.select("eye", "seq_no", "as_of", "pos", F.explode(named).alias("x")).select("eye", F.col("x.node").alias("node"), "seq_no", "as_of", "pos", "x.at")
    marks = node_ops.groupBy("eye", F.col("base").alias("node"), "seq_no").agg(F.bool_or(F.col("op") == "add_node").alias("minted"), (F.max_by("op", "pos") == "add_node").alias("stays"))
    marks = marks.select("eye", "node", "seq_no", F.struct("seq_no", "minted", "stays").alias("mark"))
    w = Window.partitionBy("eye", "node").orderBy("seq_no")
    later = Window.partitionBy("eye", "node").orderBy(F.desc("seq_no")).rangeBetween(Window.unboundedPreceding, -1)
    seen = (
        uses.unionByName(marks, allowMissingColumns=True)
        .withColumn("before", F.max("mark").over(w.rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("now", F.max("mark").over(w.rangeBetween(0, 0)))
        .withColumn("next", F.min("mark.seq_no").over(later))
        .where("pos IS NOT NULL")
    )
    minted, lives = F.coalesce("now.minted", F.lit(False)), F.coalesce("before.stays", F.lit(False))
    counts = minted | (lives & ((F.col("at") < 0) | (F.col("before.seq_no") <= F.col("as_of"))))
    stale = F.when(F.col("now").isNotNull() & ~F.col("now.stays"), F.col("seq_no")).otherwise(F.col("next"))
    refs = seen.where(counts).groupBy("eye", "pos").agg(F.sort_array(F.collect_list(F.struct("at", "node", stale.alias("stale")))).alias("refs"))
    known = edge_ops.join(refs, ["eye", "pos"]).where("refs[0].at = -1")
    known = known.withColumn("own", F.col("refs")[0]).withColumn("refs", F.filter("refs", lambda r: (r["at"] >= 0) & ((F.col("op") == "remove_edges") | (r["node"] != F.col("base"))))).where("size(refs) > 0")
    edits = known.where("side IN ('base', 'all')").select("eye", F.col("base").alias("src"), "seq_no", "pos", F.lit(-1).alias("at"), "op", "layer", "refs")
    back = known.where("side IN ('neighbors', 'all')").select("eye", F.explode("refs").alias("r"), "seq_no", "pos", "op", "layer", "own")
    back = back.select("eye", F.col("r.node").alias("src"), "seq_no", "pos", F.col("r.at").alias("at"), "op", "layer", F.array("own").alias("refs"))
    nodes_too = node_ops.select("eye", F.col("base").alias("src"), "seq_no", "pos", F.lit(-1).alias("at"), "op", "layer")
    steps = edits.unionByName(back).unionByName(nodes_too, allowMissingColumns=True)
    parts = steps.select("eye", "src", "seq_no", F.col("op").isin("add_edges", "remove_edges").alias("edit"), "pos", "at", "op", "layer", F.col("refs.node").alias("nodes"), F.transform("refs.stale", lambda z: F.coalesce(z, F.lit(1 << 62))).alias("stales"))

    order = ["eye", "src", "seq_no", "edit", "pos", "at"]
    return parts.repartition("eye", "src").sortWithinPartitions(*order).mapInArrow(fold_sorted, "eye string, layer long, src long, dst long, nbhd_seq long")


class Neighbours:
    """A neighbour list under edits. A link is stale if an edit after its own comes at its time or later; such links go in bulk."""

    def __init__(self, stamp: int):
        self.stamp, self.edits, self.added, self.least = stamp, 0, 0, 64
        self.to: dict[int, list] = {}  # target -> (stale from, edit)

    def edit(self, seq: int, remove: bool, nodes: list, stales: list) -> None:
        self.stamp, self.edits = seq, self.edits + 1
        if remove:
            for z in nodes:
                self.to.pop(z, None)
            return
        for z, stale in zip(nodes, stales):
            self.to.setdefault(z, []).append((stale, self.edits))
        self.added += len(nodes)
        if self.added > self.least:
            kept = {z: left for z, links in self.to.items() if (left := [x for x in links if self.holds(x)])}
            self.to, self.added, self.least = kept, 0, max(64, sum(map(len, kept.values())))

    def holds(self, link: tuple) -> bool:
        return link[0] > self.stamp or link[1] == self.edits

    def targets(self) -> list:
        return [z for z, links in self.to.items() for x in links if self.holds(x)]


def fold_sorted(batches):
    """Fold steps in order of eye and node, one node's lists in memory at a time."""
    import pyarrow as pa

    def made(out: list):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k else pa.string()) for k, x in enumerate(out)], names=["eye", "layer", "src", "dst", "nbhd_seq"])

    key, lists = None, {}  # layer -> Neighbours
    out: list[list] = [[], [], [], [], []]

    def close():
        for layer, held in lists.items():
            to = held.targets()
            for column, x in zip(out, (key[0], layer, key[1], None, held.stamp)):
                column.extend(to if x is None else [x] * len(to))
        lists.clear()

    for b in batches:
        column = {n: b.column(n) for n in b.schema.names}
        ends = column["nodes"].value_lengths().fill_null(0).to_pylist()
        nodes, stales, at = column["nodes"].flatten().to_pylist(), column["stales"].flatten().to_pylist(), 0
        for eye, src, seq, op, layer, n in zip(*[column[c].to_pylist() for c in ("eye", "src", "seq_no", "op", "layer")], ends):
            if (eye, src) != key:
                close()
                key = (eye, src)
                if len(out[0]) >= 50_000:
                    yield made(out)
                    for x in out:
                        x.clear()
            if op == "remove_node":
                lists.clear()
            elif op == "add_node":
                lists.update({k: Neighbours(seq) for k in range(layer + 1)})
            elif layer in lists:
                lists[layer].edit(seq, op == "remove_edges", nodes[at : at + n], stales[at : at + n])
            at += n
    close()
    yield made(out)


@query("wal_apply")
def wal_apply(spark, sf_dir):
    """A log made from all events for each eye, five to a node: nodes are added with links back, some removed or re-minted."""
    events = X.table(spark, sf_dir, "events")
    n = max(120, ((events.agg(F.max("event_id")).first()[0] or 0) + 1) // 5)
    e = events.select((F.col("event_id") + 1).alias("seq_no"), (F.col("event_id") % n).alias("base"))
    e = e.crossJoin(F.broadcast(spark.createDataFrame([("L",), ("R",)], "eye string")))
    back = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.pmod(F.col("base") - j, F.lit(n)).cast("long"))
    kind = F.when(F.col("seq_no") % 17 == 0, F.array(F.lit("remove_node"))).when(F.col("seq_no") % 11 == 0, F.array(F.lit("remove_edges"))).otherwise(F.array(F.lit("add_node"), F.lit("add_edges")))
    wal = e.withColumn("op", F.explode(kind)).select("eye", "seq_no", (F.col("seq_no") - 1).alias("as_of"), "op", "base", F.lit(0).alias("layer"), back.alias("neighbors"), F.lit("all").alias("side"))
    return apply_mutations(wal)


@query("recency_probe", f"{WITH}, m AS (SELECT DISTINCT event_id % 1500 AS serial FROM events WHERE event_id > 900) SELECT e.layer, e.dst AS neighbour, count(*) AS n FROM edges e JOIN m ON e.src = m.serial GROUP BY ALL")
def recency_probe(spark, sf_dir):
    """Which nodes the recently changed ones link to, and how often."""
    changed = X.table(spark, sf_dir, "events").where("event_id > 900").select((F.col("event_id") % id_range(spark, sf_dir)).alias("src")).distinct()
    return edges(spark, sf_dir).join(changed, "src").groupBy("layer", F.col("dst").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"))
