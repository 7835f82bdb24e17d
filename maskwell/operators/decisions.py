"""Decision rules on match results: look-back, re-authentication, mirror flags, saturation, batch decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import distance as D
from ..registry import query
from ..sources import fixtures as X
from . import matching as M

#: What a request without a match reports: the largest unsigned 32-bit number.
NO_MATCH = 4294967295
LOOKBACK, EF, MARGIN = 20, 40, 4


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch, pos, req, request_type, skip``: the queries as requests of batches of 16, in order of their serial."""
    q = X.requests(X.eyes(spark, sf_dir)).select("req")
    k = ((F.col("req") - 1) / 10).cast("long")
    kind = F.when(k % 5 == 3, "reauth").when(k % 9 == 4, "reset_check").otherwise("uniqueness")
    return q.select("req", F.floor(k / 16).cast("long").alias("batch"), (k % 16).cast("long").alias("pos"), kind.alias("request_type"), (k % 7 == 2).alias("skip"))


REQUESTS = """requests AS (
  SELECT req, k // 16 AS batch, k % 16 AS pos, CASE WHEN k % 5 = 3 THEN 'reauth' WHEN k % 9 = 4 THEN 'reset_check' ELSE 'uniqueness' END AS request_type, k % 7 = 2 AS skip
  FROM (SELECT DISTINCT req, (req - 1) // 10 AS k FROM q))"""
WITH = f"{M.WITH}, {REQUESTS}"


@query("luc_lookback", f"{WITH}, top AS (SELECT DISTINCT serial FROM d ORDER BY serial DESC LIMIT {LOOKBACK + 1}), ids AS (SELECT req, serial FROM requests, top WHERE request_type NOT IN ('reauth', 'reset_check', 'recovery_check') UNION SELECT req, least(serial, 100) FROM requests r, (SELECT unnest([2, 3, 5]) AS serial) WHERE req % 20 = 1) SELECT ids.req, ids.serial, close_l OR close_r AS is_match FROM ids JOIN wide USING (req, serial)")
def luc_lookback(spark, sf_dir):
    """Rule ids and the N + 1 newest serials, where either eye matches; checks and re-authentication don't look back."""
    e = X.eyes(spark, sf_dir)
    top = X.database(e).select("serial").orderBy(F.desc("serial")).limit(LOOKBACK + 1)
    r = request_table(spark, sf_dir)
    back = r.where(~F.col("request_type").isin("reauth", "reset_check", "recovery_check")).select("req").crossJoin(F.broadcast(top))  # N + 1 rows
    rule = r.where("req % 20 = 1").select("req", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)).cast("array<bigint>")).alias("serial"))
    pairs = named_pairs(spark, sf_dir, back.union(rule).distinct())
    return pairs.select("req", "serial", (M.is_close("l") | M.is_close("r")).alias("is_match"))


def named_pairs(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """``req, serial, hd_l, md_l, hd_r, md_r`` of the pairs in ``ids``: two joins by id, no other pair is looked at."""
    q, d = M.sides(spark, sf_dir)
    rows = ids.join(q.select("req", *[F.col(c).alias(f"q_{c}") for c in q.columns[1:]]), "req").join(d, "serial")
    pair = lambda s: D.hd_md(F.col(f"q_code_{s}"), F.col(f"q_mask_{s}"), F.col(f"code_{s}"), F.col(f"mask_{s}"))
    return rows.select("req", "serial", *[x.alias(f"{n}_{s}") for s in "lr" for n, x in zip(("hd", "md"), pair(s))])


@query("reauth_rule", f"{WITH} SELECT r.req, t AS target, r.req % 3 = 0 AS or_rule, CASE WHEN r.req % 3 = 0 THEN close_l OR close_r ELSE close_l AND close_r END AS success FROM (SELECT *, req + 1 AS t FROM requests WHERE request_type = 'reauth') r JOIN wide w ON w.req = r.req AND w.serial = t")
def reauth_rule(spark, sf_dir):
    r = request_table(spark, sf_dir).where("request_type = 'reauth'").select("req", (F.col("req") + 1).alias("serial"))
    rows = named_pairs(spark, sf_dir, r)
    either = F.col("req") % 3 == 0
    return rows.select("req", F.col("serial").alias("target"), either.alias("or_rule"), F.when(either, M.is_close("l") | M.is_close("r")).otherwise(M.is_close("l") & M.is_close("r")).alias("success"))


def mirrored(x):
    """The 32 bits in reverse order: the small fixture's mirror."""
    out = F.lit(0).cast("long")
    for i in range(32):
        out = out.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", x, F.lit(i)).bitwiseAND(F.lit(1).cast("long")), F.lit(31 - i)))
    return out


_REV = "list_sum(list_transform(range(0, 32), lambda i: ((({c} >> i) & 1) << (31 - i))::BIGINT))::BIGINT"
MIRROR = f"""mq AS (SELECT req, CASE eye WHEN 'L' THEN 'R' ELSE 'L' END AS eye, {_REV.format(c="code")} AS code, {_REV.format(c="mask")} AS mask FROM q),
  mp AS (SELECT req, serial, mq.eye, bit_count(xor(mq.code, d.code) & mq.mask & d.mask)::BIGINT AS hd, bit_count(mq.mask & d.mask)::BIGINT AS md FROM mq JOIN d ON mq.eye = d.eye),
  mw AS (SELECT l.req, l.serial FROM mp l JOIN mp r ON l.req = r.req AND l.serial = r.serial AND l.eye = 'L' AND r.eye = 'R' WHERE l.md > 0 AND r.md > 0 AND l.hd < l.md * 0.345::DOUBLE AND r.hd < r.md * 0.345::DOUBLE)"""


@query("mirror_attack", f"{WITH}, {MIRROR}, n AS (SELECT req, count(*) AS n FROM wide WHERE close_l AND close_r GROUP BY req), m AS (SELECT req, count(*) AS n FROM mw GROUP BY req) SELECT r.req, coalesce(n.n, 0)::BIGINT AS normal_n, coalesce(m.n, 0)::BIGINT AS mirror_n, coalesce(n.n, 0) = 0 AND coalesce(m.n, 0) > 0 AS attack FROM requests r LEFT JOIN n USING (req) LEFT JOIN m USING (req)")
def mirror_attack(spark, sf_dir):
    """Requests that match nothing as they are and something in the mirror, with the eyes swapped. One scan does both."""
    q, d = M.sides(spark, sf_dir)
    q = q.select("*", *[mirrored(F.col(f"{c}_{o}")).alias(f"{c}_m{s}") for c in ("code", "mask") for s, o in ("lr", "rl")])

    def both(q, d, at):
        plain, turned = ([B.Side(q, d, at, q_end=f"_{m}{s}", d_end=f"_{s}") for s in "lr"] for m in ("", "m"))
        return [M.both_match(*plain), M.both_match(*turned)]

    n = B.compared(q, d, B.counts(both), "req bigint, normal_n bigint, mirror_n bigint")
    rows = n.groupBy("req").agg(F.sum("normal_n").alias("normal_n"), F.sum("mirror_n").alias("mirror_n"))
    return rows.withColumn("attack", (F.col("normal_n") == 0) & (F.col("mirror_n") > 0))


@query("merged_results", f"{WITH}, m AS (SELECT req, min(serial) - 1 AS first, list(serial - 1 ORDER BY serial) AS ids FROM wide WHERE close_l AND close_r GROUP BY req) SELECT r.req, coalesce(first, {NO_MATCH})::BIGINT AS merged, coalesce(ids, []) AS match_ids FROM requests r LEFT JOIN m USING (req)")
def merged_results(spark, sf_dir):
    """The first match, 0-based, or the largest 32-bit number; and the sorted list of matches."""
    hits = M.both_eyes(spark, sf_dir, M.both_match).groupBy("req").agg(F.min(F.col("serial") - 1).alias("first"), F.sort_array(F.collect_set(F.col("serial") - 1)).alias("ids"))
    return request_table(spark, sf_dir).select("req").join(hits, "req", "left").select("req", F.coalesce("first", F.lit(NO_MATCH)).cast("long").alias("merged"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("match_ids"))


@query("saturation", f"WITH {M.ROTATED}, n AS (SELECT req, rot, count(*) AS n FROM rpairs WHERE eye = 'L' AND md > 0 AND hd < md * 0.345::DOUBLE GROUP BY ALL) SELECT req, max(n) AS most, bool_or(n + {MARGIN} >= {EF}) AS saturated FROM n GROUP BY req")
def saturation(spark, sf_dir):
    """Whether a search fills its candidate list in any rotation, so that matches may be missing."""

    def kernel(q, d):
        import numpy as np

        for k, turned in enumerate(B.rotations(q, M.REACH, ("",))):
            for req, n in B.counts(lambda q, d, at: [B.Side(q, d, at).close(D.STRICT)])(turned, d):
                yield [req[n > 0], np.full((n > 0).sum(), k), n[n > 0]]

    found = B.compared(*M.left_sides(spark, sf_dir), kernel, "req bigint, rot int, n bigint")
    n = found.groupBy("req", "rot").agg(F.sum("n").alias("n"))
    return n.groupBy("req").agg(F.max("n").alias("most"), F.bool_or(F.col("n") + MARGIN >= EF).alias("saturated"))


def decide(requests: DataFrame) -> DataFrame:
    """Decide each batch in request order.

    ``requests`` has ``batch, pos, request_type, skip, has_match, reauth_ok, earlier`` (positions that the request matched
    within its batch). A match inside the batch blocks only if the earlier request itself mutates, so a request depends
    on decisions before it; a batch is bounded by construction and is folded in one call.
    """

    def fold(rows):
        decided: dict[int, str] = {}
        rows = rows.sort_values("pos")
        for r in rows.itertuples():
            if r.request_type == "uniqueness":
                blocked = r.has_match or any(decided.get(p) in ("insert", "update") for p in r.earlier)
                decided[r.pos] = "none" if blocked else "insert_skipped" if r.skip else "insert"
            elif r.request_type == "reauth":
                decided[r.pos] = "update" if r.reauth_ok else "none"
            else:
                decided[r.pos] = "none"
        return rows.assign(decision=[decided[p] for p in rows["pos"]])[["batch", "pos", "req", "decision"]]

    return requests.groupBy("batch").applyInPandas(fold, "batch long, pos long, req long, decision string")


def decision_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = request_table(spark, sf_dir)
    hits = M.both_eyes(spark, sf_dir, lambda left, right: M.both_match(left, right, 0.3)).select("req").distinct().withColumn("has_match", F.lit(True))
    near = M.intra_batch_pairs(spark, sf_dir).where("left_match AND right_match")
    place = r.select("req", "batch", "pos")
    near = near.join(place.toDF("later", "batch", "pos"), "later").join(place.toDF("earlier", "e_batch", "e_pos"), "earlier").where("batch = e_batch").groupBy(F.col("later").alias("req")).agg(F.collect_list("e_pos").alias("earlier"))
    return r.join(hits, "req", "left").join(near, "req", "left").select("batch", "pos", "req", "request_type", "skip", F.coalesce("has_match", F.lit(False)).alias("has_match"), (F.col("req") % 3 == 0).alias("reauth_ok"), F.coalesce("earlier", F.array().cast("array<bigint>")).alias("earlier"))


@query("batch_decide", f"""WITH RECURSIVE {M.WITH[5:]}, {REQUESTS},
  hits AS (SELECT DISTINCT req FROM wide WHERE hd_l < md_l * 0.3::DOUBLE AND hd_r < md_r * 0.3::DOUBLE AND md_l > 0 AND md_r > 0),
  qq AS (SELECT a.req AS later, b.req AS earlier, a.eye, bit_count(a.mask & b.mask) AS md, bit_count(xor(a.code, b.code) & a.mask & b.mask) AS hd FROM q a JOIN q b ON a.eye = b.eye AND a.req > b.req),
  near AS (SELECT later, earlier FROM qq WHERE md > 0 AND hd < md * 0.345::DOUBLE GROUP BY ALL HAVING count(*) = 2),
  inb AS (SELECT r.req, list(e.pos) AS ps FROM near n JOIN requests r ON r.req = n.later JOIN requests e ON e.req = n.earlier AND e.batch = r.batch GROUP BY r.req),
  inp AS (SELECT r.*, hits.req IS NOT NULL AS has_match, coalesce(inb.ps, []) AS ps FROM requests r LEFT JOIN hits ON hits.req = r.req LEFT JOIN inb ON inb.req = r.req),
  fold AS (
    SELECT batch, -1::BIGINT AS pos, -1::BIGINT AS req, '' AS decision, []::BIGINT[] AS mut FROM (SELECT DISTINCT batch FROM inp)
    UNION ALL
    SELECT batch, pos, req, decision, CASE WHEN decision IN ('insert', 'update') THEN list_append(mut, pos) ELSE mut END FROM (
      SELECT i.batch, i.pos, i.req, f.mut, CASE WHEN request_type = 'uniqueness' THEN CASE WHEN has_match OR list_has_any(ps, f.mut) THEN 'none' WHEN skip THEN 'insert_skipped' ELSE 'insert' END
        WHEN request_type = 'reauth' AND i.req % 3 = 0 THEN 'update' ELSE 'none' END AS decision
      FROM fold f JOIN inp i ON i.batch = f.batch AND i.pos = f.pos + 1))
  SELECT batch, pos, req, decision FROM fold WHERE pos >= 0""")
def batch_decide(spark, sf_dir):
    return decide(decision_input(spark, sf_dir))


@query("insertion_allocation", f"{WITH} SELECT r.req, (SELECT max(serial) FROM d) + row_number() OVER (ORDER BY r.req) AS new_serial, (((SELECT max(serial) FROM d) + row_number() OVER (ORDER BY r.req)) % 4)::BIGINT AS device FROM requests r WHERE request_type = 'uniqueness' AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.req = r.req AND close_l AND close_r)")
def insertion_allocation(spark, sf_dir):
    """Serials for requests without a match, after the highest one, dealt to four devices in turn.

    The numbered side is one request batch, which is bounded.
    """
    e = X.eyes(spark, sf_dir)
    hits = M.match_both_and(spark, sf_dir).select("req")
    new = request_table(spark, sf_dir).where("request_type = 'uniqueness'").join(hits, "req", "left_anti").select("req")
    top = X.database(e).agg(F.coalesce(F.max("serial"), F.lit(0)).alias("top"))
    numbered = new.withColumn("k", F.row_number().over(Window.orderBy("req"))).crossJoin(F.broadcast(top))
    return numbered.select("req", (F.col("top") + F.col("k")).alias("new_serial"), ((F.col("top") + F.col("k")) % 4).alias("device"))


@query("request_validation", f"{WITH}, p AS (SELECT req, batch, pos, 'r' || (req % 97) AS label, CASE WHEN req % 4 = 1 THEN 'r' || ((req + 10) % 97) END AS parent FROM requests), dup AS (SELECT label FROM p GROUP BY label HAVING count(*) > 1) SELECT p.req, p.label, dup.label IS NOT NULL AS duplicate_label, p.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p x WHERE x.label = p.parent) AS missing_parent, coalesce((SELECT min(x.batch) FROM p x WHERE x.label = p.parent) > p.batch, false) AS parent_too_late FROM p LEFT JOIN dup ON dup.label = p.label")
def request_validation(spark, sf_dir):
    """Labels must be unique, parents must exist and must not come in a later batch."""
    r = request_table(spark, sf_dir)
    p = r.select("req", "batch", F.concat(F.lit("r"), F.col("req") % 97).alias("label"), F.when(F.col("req") % 4 == 1, F.concat(F.lit("r"), (F.col("req") + 10) % 97)).alias("parent"))
    known = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first"))
    own = p.join(known.select("label", (F.col("n") > 1).alias("duplicate_label")), "label")
    up = own.join(known.select(F.col("label").alias("parent"), "first"), "parent", "left")
    return up.select("req", "label", "duplicate_label", (F.col("parent").isNotNull() & F.col("first").isNull()).alias("missing_parent"), F.coalesce(F.col("first") > F.col("batch"), F.lit(False)).alias("parent_too_late"))


@query("insertion_list", f"{WITH}, {MIRROR} SELECT req FROM requests r WHERE request_type = 'uniqueness' AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.req = r.req AND close_l AND close_r) AND NOT EXISTS (SELECT 1 FROM mw WHERE mw.req = r.req)")
def insertion_list(spark, sf_dir):
    """Uniqueness requests that match neither as they are nor in the mirror."""
    clear = mirror_attack(spark, sf_dir).where("normal_n = 0 AND mirror_n = 0").select("req")
    return request_table(spark, sf_dir).where("request_type = 'uniqueness'").join(clear, "req", "left_semi").select("req")


@query("partial_count_rule", f"{WITH}, n AS (SELECT req, count(*) FILTER (close_l) AS l, count(*) FILTER (close_r) AS r, count(*) FILTER (close_l AND close_r) AS b FROM wide GROUP BY req) SELECT req, l AS left_n, r AS right_n, b = 0 AND l <= 25 AND r <= 25 AS is_unique FROM n")
def partial_count_rule(spark, sf_dir):
    """Unique only without a full match and with few partial ones in either eye."""

    def partial(q, d, at):
        left, right = (s.close(D.STRICT) for s in M.both_sides(q, d, at))
        return [left, right, left & right]

    n = B.compared(*M.sides(spark, sf_dir), B.counts(partial, some=True), "req bigint, l bigint, r bigint, b bigint")
    rows = n.groupBy("req").agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"), F.sum("b").alias("b"))
    return rows.select("req", "left_n", "right_n", ((F.col("b") == 0) & (F.col("left_n") <= 25) & (F.col("right_n") <= 25)).alias("is_unique"))
