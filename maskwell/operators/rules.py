"""Decision rules over tagged match facts: filters, uniqueness, extended searches, mutation plans, request validation.

A fact says that a request matched something: ``req, kind, id, l, r, or_rule, orient, variant``. Kinds are search, luc,
reauth, intra and supermatch. Everything is a column expression and one aggregation per request, so facts are reduced
before they are shuffled, however many a hot request has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources import fixtures as X

KINDS = ["search", "luc", "reauth", "intra", "supermatch"]


@dataclass(frozen=True)
class Filter:
    """Which facts count: eyes ``left``, ``right`` or ``both``; orientation ``normal``, ``mirror`` or ``both``; peers of the batch or not."""

    eyes: str = "both"
    orient: str = "both"
    intra_batch: bool = True

    def column(self) -> Column:
        return holds(F.lit(self.eyes), F.lit(self.orient), F.lit(self.intra_batch))


def holds(eyes: Column, orient: Column, intra_batch: Column) -> Column:
    """Whether a fact counts. With both eyes, search and intra ask for both, luc and supermatch for either, reauth as it says."""
    left, right, kind = F.col("l"), F.col("r"), F.col("kind")
    either = kind.isin("luc", "supermatch") | ((kind == "reauth") & F.col("or_rule"))
    seen = F.when(eyes == "left", left).when(eyes == "right", right).when(either, left | right).otherwise(left & right)
    return seen & ((orient == "both") | (orient == F.col("orient"))) & ((kind != "intra") | intra_batch)


def facts(spark, sf_dir) -> DataFrame:
    """Events as match facts; ``variant`` says which search brought them: the first one, the extended one, or both."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("search", "search", "search", "luc", "reauth", "intra", "supermatch")]), (k % 7 + 1).cast("int"))
    return X.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("req"), kind.alias("kind"), (k * 13 % 500).alias("id"), (k * 5 % 11 < 5).alias("l"), (k * 3 % 13 < 5).alias("r"), (k % 2 == 0).alias("or_rule"),
        F.when(k % 3 == 0, "mirror").otherwise("normal").alias("orient"), F.when(k % 10 == 0, "baseline").when(k % 10 < 4, "extended").otherwise("any").alias("variant"),
    )


FACTS = """facts AS (
  SELECT user_id AS req, ['search', 'search', 'search', 'luc', 'reauth', 'intra', 'supermatch'][event_id % 7 + 1] AS kind, event_id * 13 % 500 AS id, event_id * 5 % 11 < 5 AS l, event_id * 3 % 13 < 5 AS r,
         event_id % 2 = 0 AS or_rule, CASE WHEN event_id % 3 = 0 THEN 'mirror' ELSE 'normal' END AS orient, CASE WHEN event_id % 10 = 0 THEN 'baseline' WHEN event_id % 10 < 4 THEN 'extended' ELSE 'any' END AS variant FROM events),
  chosen AS (SELECT *, CASE WHEN kind IN ('luc', 'supermatch') OR kind = 'reauth' AND or_rule THEN l OR r ELSE l AND r END AS ok FROM facts)"""
WITH = f"WITH {FACTS} "


@query("match_sources", f"{WITH} SELECT DISTINCT req, kind, CASE WHEN kind <> 'supermatch' THEN id END AS id FROM chosen WHERE ok AND variant <> 'baseline'")
def match_sources(spark, sf_dir):
    """Everything that a request matched, each with its source; a saturated search is a match without an id."""
    found = facts(spark, sf_dir).where(Filter().column() & (F.col("variant") != "baseline"))
    return found.select("req", "kind", F.when(F.col("kind") != "supermatch", F.col("id")).alias("id")).distinct()


@query("filter_views", f"{WITH}, v AS (SELECT * FROM (VALUES ('left'), ('right'), ('both')) e(eyes), (VALUES ('normal'), ('mirror'), ('both')) o(want), (VALUES (true), (false)) i(intra_batch)) SELECT eyes, want, intra_batch, count(*) AS n FROM facts, v WHERE (CASE WHEN eyes = 'left' THEN l WHEN eyes = 'right' THEN r WHEN kind IN ('luc', 'supermatch') OR kind = 'reauth' AND or_rule THEN l OR r ELSE l AND r END) AND (want = 'both' OR want = orient) AND (kind <> 'intra' OR intra_batch) GROUP BY ALL")
def filter_views(spark, sf_dir):
    """How many facts each of the 18 filters keeps, in one pass."""
    views = [(e, o, i) for e in ("left", "right", "both") for o in ("normal", "mirror", "both") for i in (True, False)]
    sums = facts(spark, sf_dir).agg(*[F.count_if(Filter(*v).column()).alias(f"n{k}") for k, v in enumerate(views)])
    rows = F.array(*[F.struct(F.lit(e).alias("eyes"), F.lit(o).alias("want"), F.lit(i).alias("intra_batch"), F.col(f"n{k}").alias("n")) for k, (e, o, i) in enumerate(views)])
    return sums.select(F.inline(rows)).where("n > 0")


def outcome(found: DataFrame, mutates: Column, variants: dict[str, Column]) -> DataFrame:
    """Per request and variant: ``<name>_match`` and ``<name>_only_super``.

    A peer of the batch blocks only if it comes earlier and itself mutates; a saturated search blocks by itself, and is the
    only reason where nothing else matched.
    """
    ordinary = F.col("kind").isin("search", "luc", "reauth") | ((F.col("kind") == "intra") & mutates)
    sums = [F.bool_or(when & c).alias(f"{name}_{what}") for name, when in variants.items() for what, c in (("ordinary", ordinary), ("super", F.col("kind") == "supermatch"))]
    rows = found.groupBy("req").agg(*sums)
    return rows.select("req", *[x for n in variants for x in ((F.col(f"{n}_ordinary") | F.col(f"{n}_super")).alias(f"{n}_match"), (F.col(f"{n}_super") & ~F.col(f"{n}_ordinary")).alias(f"{n}_only_super"), F.col(f"{n}_ordinary").alias(f"{n}_real"))])


def earlier_mutation() -> Column:
    return (F.col("id") < F.col("req")) & (F.col("id") % 4 == 1)


@query("uniqueness", f"{WITH}, o AS (SELECT req, bool_or(kind IN ('search', 'luc', 'reauth') OR kind = 'intra' AND id < req AND id % 4 = 1) AS ordinary, bool_or(kind = 'supermatch') AS super FROM chosen WHERE ok AND variant <> 'baseline' GROUP BY req) SELECT req, ordinary OR super AS is_match, super AND NOT ordinary AS only_supermatch FROM o")
def uniqueness(spark, sf_dir):
    found = facts(spark, sf_dir).where(Filter().column())
    got = outcome(found.where("variant <> 'baseline'"), earlier_mutation(), {"final": F.lit(True)})
    return got.select("req", F.col("final_match").alias("is_match"), F.col("final_only_super").alias("only_supermatch"))


@query("extension_outcome", f"{WITH}, o AS (SELECT req, variant, kind = 'supermatch' AS s, kind IN ('search', 'luc', 'reauth') OR kind = 'intra' AND id < req AND id % 4 = 1 AS m FROM chosen WHERE ok) SELECT req, coalesce(bool_or((m OR s) AND variant <> 'baseline'), false) AS extended_decision, coalesce(bool_or(m AND variant <> 'baseline'), false) AS extended_match, coalesce(bool_or(m AND variant <> 'extended'), false) AS baseline_match FROM o GROUP BY req")
def extension_outcome(spark, sf_dir):
    """What an extended search changed: its decision, its real matches, and those that the first search had alone."""
    found = facts(spark, sf_dir).where(Filter().column())
    got = outcome(found, earlier_mutation(), {"extended": F.col("variant") != "baseline", "baseline": F.col("variant") != "extended"})
    return got.select("req", F.col("extended_match").alias("extended_decision"), F.col("extended_real").alias("extended_match"), F.col("baseline_real").alias("baseline_match"))


@query("party_disagreement", "WITH p AS (SELECT party, c_custkey AS req, CASE WHEN party = 2 AND c_custkey % 97 = 5 THEN c_custkey + 1 ELSE c_custkey % 50 END AS result FROM customer, (SELECT unnest([0, 1, 2]) AS party) WHERE NOT (party = 1 AND c_custkey % 101 = 3)) SELECT req, count(*) AS parties, min(result) AS low, max(result) AS high FROM p GROUP BY req HAVING count(*) < 3 OR min(result) <> max(result)")
def party_disagreement(spark, sf_dir):
    """Requests on which the parties' results differ or a party has none; no rows mean agreement."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req"), F.explode(F.array(*map(F.lit, range(3)))).alias("party"))
    p = c.where("NOT (party = 1 AND req % 101 = 3)").withColumn("result", F.expr("CASE WHEN party = 2 AND req % 97 = 5 THEN req + 1 ELSE req % 50 END"))
    return p.groupBy("req").agg(F.count(F.lit(1)).alias("parties"), F.min("result").alias("low"), F.max("result").alias("high")).where("parties < 3 OR low <> high")


@query("pair_consistency", "SELECT side, idx, count(DISTINCT partner) AS partners FROM (SELECT 'left' AS side, o_custkey AS idx, o_orderkey % 3 AS partner FROM orders UNION ALL SELECT 'right', o_orderkey % 3, o_custkey FROM orders) GROUP BY ALL HAVING count(DISTINCT partner) > 1")
def pair_consistency(spark, sf_dir):
    """Indices of a request file that belong to more than one pair."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 3).alias("b")).distinct()
    both = o.select(F.lit("left").alias("side"), F.col("a").alias("idx"), F.col("b").alias("partner")).union(o.select(F.lit("right"), "b", "a"))
    return both.groupBy("side", "idx").agg(F.count(F.lit(1)).alias("partners")).where("partners > 1")


SLOTS = """slots AS (
  SELECT event_id AS slot, user_id AS serial, CASE WHEN event_id % 5 < 3 THEN 'request' WHEN event_id % 5 = 3 THEN 'identity_update' ELSE 'deletion' END AS kind,
         CASE WHEN event_id % 5 < 3 THEN ['unique_insert', 'reauth_update', 'unique_insert_skipped', 'no_mutation'][event_id % 4 + 1] END AS decision, event_id % 6 = 0 AS skip, CASE WHEN event_id % 2 = 0 THEN 'normal' ELSE 'mirror' END AS orient FROM events)"""


def slots(spark, sf_dir) -> DataFrame:
    """The slots of request batches: a decided request, an identity update, or a deletion."""
    k = F.col("event_id")
    kind = F.when(k % 5 < 3, "request").when(k % 5 == 3, "identity_update").otherwise("deletion")
    decision = F.when(k % 5 < 3, F.element_at(F.array(*[F.lit(x) for x in ("unique_insert", "reauth_update", "unique_insert_skipped", "no_mutation")]), (k % 4 + 1).cast("int")))
    return X.table(spark, sf_dir, "events").select(k.alias("slot"), F.col("user_id").alias("serial"), kind.alias("kind"), decision.alias("decision"), (k % 6 == 0).alias("skip"), F.when(k % 2 == 0, "normal").otherwise("mirror").alias("orient"))


@query("mutation_plan", f"WITH {SLOTS}, u AS (SELECT *, CASE WHEN kind = 'identity_update' OR decision = 'reauth_update' AND NOT skip THEN serial END AS update_id FROM slots) SELECT slot, update_id, CASE WHEN kind = 'deletion' THEN serial ELSE update_id END AS replace_id, kind = 'identity_update' OR coalesce(decision = 'unique_insert' OR decision = 'reauth_update' AND NOT skip, false) AS inserts, CASE WHEN decision = 'unique_insert' THEN 'request:' || slot WHEN update_id IS NOT NULL OR kind = 'deletion' THEN 'serial:' || serial END AS change_key FROM u")
def mutation_plan(spark, sf_dir):
    """What each slot does to the graph: the id it updates, the id whose node goes, whether it inserts, and its key in the change log."""
    updates = (F.col("kind") == "identity_update") | ((F.col("decision") == "reauth_update") & ~F.col("skip"))
    s = slots(spark, sf_dir).withColumn("update_id", F.when(updates, F.col("serial")))
    deletes, unique = F.col("kind") == "deletion", F.coalesce(F.col("decision") == "unique_insert", F.lit(False))
    key = F.when(unique, F.concat(F.lit("request:"), F.col("slot"))).when(F.col("update_id").isNotNull() | deletes, F.concat(F.lit("serial:"), F.col("serial")))
    return s.select("slot", "update_id", F.when(deletes, F.col("serial")).otherwise(F.col("update_id")).alias("replace_id"), (F.col("update_id").isNotNull() | unique).alias("inserts"), key.alias("change_key"))


@query("request_targets", f"WITH {SLOTS} SELECT slot, orient, kind = 'request' AND decision = 'reauth_update' AND orient = 'normal' AS checks_target, CASE WHEN kind = 'request' AND decision = 'reauth_update' AND orient = 'normal' THEN serial END AS target FROM slots WHERE kind = 'request'")
def request_targets(spark, sf_dir):
    """Re-authentication looks at its target in the normal orientation only."""
    checks = (F.col("decision") == "reauth_update") & (F.col("orient") == "normal")
    return slots(spark, sf_dir).where("kind = 'request'").select("slot", "orient", checks.alias("checks_target"), F.when(checks, F.col("serial")).alias("target"))


@query("modification_states", f"WITH {X.CHANGES} SELECT id, request_type IN ('click', 'view') AS updating, status = 'COMPLETED' AND persisted AS finalized FROM mods")
def modification_states(spark, sf_dir):
    return X.changes(spark, sf_dir).select("id", F.col("request_type").isin("click", "view").alias("updating"), ((F.col("status") == "COMPLETED") & F.col("persisted")).alias("finalized"))


@query("extension_updates", f"WITH {X.CHANGES}, s AS (SELECT id, status = 'COMPLETED' AND persisted AS f FROM mods WHERE id % 4 <> 0) SELECT e.id, e.serial_id FROM mods e LEFT JOIN s ON s.id = e.id WHERE (e.status = 'COMPLETED' OR e.id % 8 = 7) AND e.persisted AND request_type IN ('click', 'view') AND NOT coalesce(s.f, false)")
def extension_updates(spark, sf_dir):
    """Serials to be updated between two states of the change log: finalized updating changes that weren't final before."""
    m = X.changes(spark, sf_dir)
    final = (F.col("status") == "COMPLETED") & F.col("persisted")
    before = m.where("id % 4 <> 0").where(final).select("id")
    after = m.where(((F.col("status") == "COMPLETED") | (F.col("id") % 8 == 7)) & F.col("persisted") & F.col("request_type").isin("click", "view"))
    return after.join(before, "id", "left_anti").select("id", "serial_id")


@query("extension_validity", f"WITH {X.CHANGES}, s AS (SELECT id, serial_id, request_type, status = 'COMPLETED' AND persisted AS f FROM mods WHERE id % 4 <> 0), e AS (SELECT id, serial_id, CASE WHEN id % 211 = 1 THEN 'other' ELSE request_type END AS request_type, CASE WHEN id % 307 = 2 THEN false ELSE status = 'COMPLETED' AND persisted END AS f FROM mods WHERE id % 199 <> 3) SELECT s.id, CASE WHEN e.id IS NULL THEN 'missing' WHEN e.serial_id <> s.serial_id OR e.request_type <> s.request_type THEN 'changed' ELSE 'reopened' END AS fault FROM s LEFT JOIN e ON e.id = s.id WHERE e.id IS NULL OR e.serial_id <> s.serial_id OR e.request_type <> s.request_type OR s.f AND NOT e.f")
def extension_validity(spark, sf_dir):
    """Why a later state of the change log doesn't extend an earlier one: rows gone, changed, or final no more."""
    m = X.changes(spark, sf_dir).select("id", "serial_id", "request_type", ((F.col("status") == "COMPLETED") & F.col("persisted")).alias("f"))
    later = m.where("id % 199 <> 3").select("id", F.col("serial_id").alias("s2"), F.when(F.col("id") % 211 == 1, "other").otherwise(F.col("request_type")).alias("t2"), (F.col("f") & (F.col("id") % 307 != 2)).alias("f2"))
    rows = m.where("id % 4 <> 0").join(later, "id", "left")
    fault = F.when(F.col("s2").isNull(), "missing").when((F.col("s2") != F.col("serial_id")) | (F.col("t2") != F.col("request_type")), "changed").when(F.col("f") & ~F.col("f2"), "reopened")
    return rows.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def mismatches(actual, expected, path: str = "") -> list[str]:
    """Where ``actual`` lacks or contradicts ``expected``, both parsed JSON; what ``expected`` doesn't name is free."""
    if isinstance(expected, dict) and isinstance(actual, dict):
        return [m for k, v in expected.items() for m in (mismatches(actual[k], v, f"{path}.{k}") if k in actual else [f"{path}.{k}: missing"])]
    return [] if actual == expected else [f"{path or '.'}: {actual!r} is not {expected!r}"]
