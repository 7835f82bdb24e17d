"""Similarity joins and top-k: requests against the database, by pairs of blocks (``functions.blocks``).

Both eyes of an identity stand in one row, which replaces the reference model's semi-join between eyes; no join but the
theta join itself is left, and what a query doesn't return is reduced inside its block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import distance as D
from ..registry import query
from ..sources import fixtures as X

EYES = (("L", "_l"), ("R", "_r"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and database, both eyes in one row."""
    e = X.eyes(spark, sf_dir)
    of = ("code_l", "mask_l", "code_r", "mask_r")
    return X.requests(e).select("req", *of), X.database(e).select("serial", *of)


def eye_pairs(spark: SparkSession, sf_dir: str, keep: Callable[[B.Side], object] | None = None) -> DataFrame:
    """``req, serial, eye, hd, md`` for every query and database row, eye by eye; with ``keep`` for those that it marks."""

    def everything(q, d, at, beside):
        for eye, end in EYES:
            s = B.Side(q, d, at, beside, end, end)
            yield None, B.said(eye, s.hd.size), s.hd.ravel(), s.md.ravel()

    def marked(eye, end):
        def rows(q, d, at):
            s = B.Side(q, d, at, q_end=end, d_end=end)
            return keep(s), lambda part: B.said(eye, len(part)), s.hd, s.md

        return B.matches(rows)

    def kernel(q, d):
        for eye, end in EYES:
            yield from marked(eye, end)(q, d)

    schema = "req bigint, serial bigint, eye string, hd bigint, md bigint"
    return B.compared(*sides(spark, sf_dir), kernel, schema) if keep else B.compared(*sides(spark, sf_dir), B.every(everything), schema, B.ROWS_OUT)


def both_eyes(spark: SparkSession, sf_dir: str, keep: Callable[[B.Side, B.Side], object] | None = None) -> DataFrame:
    """``req, serial, hd_l, md_l, hd_r, md_r`` of every pair, or of those that ``keep`` marks by their left and right distances."""

    def rows(q, d, at):
        left, right = both_sides(q, d, at)
        return keep(left, right) if keep else left.hd >= 0, left.hd, left.md, right.hd, right.md

    return B.compared(*sides(spark, sf_dir), B.matches(rows), "req bigint, serial bigint, hd_l bigint, md_l bigint, hd_r bigint, md_r bigint")


def both_sides(q: dict, d: dict, at: slice) -> tuple[B.Side, B.Side]:
    return B.Side(q, d, at, q_end="_l", d_end="_l"), B.Side(q, d, at, q_end="_r", d_end="_r")


def left_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and database with the left eye's ``code, mask``."""
    return tuple(x.select(x.columns[0], F.col("code_l").alias("code"), F.col("mask_l").alias("mask")) for x in sides(spark, sf_dir))


def both_match(left: B.Side, right: B.Side, threshold: float = D.STRICT):
    return left.close(threshold) & right.close(threshold)


def is_close(side: str, threshold: float = D.STRICT) -> Column:
    return D.close(F.col(f"hd_{side}"), F.col(f"md_{side}"), threshold)


WIDE = "wide AS (SELECT l.req, l.serial, l.hd AS hd_l, l.md AS md_l, r.hd AS hd_r, r.md AS md_r, l.md > 0 AND l.hd < l.md * 0.345::DOUBLE AS close_l, r.md > 0 AND r.hd < r.md * 0.345::DOUBLE AS close_r FROM pairs l JOIN pairs r ON l.req = r.req AND l.serial = r.serial AND l.eye = 'L' AND r.eye = 'R')"
WITH = f"WITH {X.CODES}, {WIDE} "
WINDOW_K = "row_number() OVER (PARTITION BY req ORDER BY hd::DOUBLE / md, serial)"


@query("fhd_pairs", f"WITH {X.CODES} SELECT req, serial, eye, hd, md, CASE WHEN md > 0 THEN hd::DOUBLE / md END AS fhd FROM pairs")
def fhd_pairs(spark, sf_dir):
    return eye_pairs(spark, sf_dir).withColumn("fhd", D.fhd(F.col("hd"), F.col("md")))


@query("dot_pairs", f"WITH {X.CODES} SELECT req, serial, eye, md - 2 * hd AS dot, md FROM pairs")
def dot_pairs(spark, sf_dir):
    return eye_pairs(spark, sf_dir).select("req", "serial", "eye", D.dot(F.col("hd"), F.col("md")).alias("dot"), "md")


@query("nhd_pairs", f"WITH {X.CODES} SELECT req, serial, eye, md * (20 * hd - 9 * md) + 147456 * hd AS nmr, md FROM pairs")
def nhd_pairs(spark, sf_dir):
    return eye_pairs(spark, sf_dir).select("req", "serial", "eye", D.nhd_numerator(F.col("hd"), F.col("md")).alias("nmr"), "md")


REACH = 3


def one_row(rows: DataFrame, spark, sf_dir, group: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` of pairs, brought together by ``group`` where an id comes twice."""
    q, d = sides(spark, sf_dir)
    return rows if B.unique(q.select("req"), "req") and B.unique(d.select("serial"), "serial") else group(rows)


def min_rotation(spark, sf_dir, order: str) -> DataFrame:
    """The least distance over rotations of the query side only; the database is never rotated. The first rotation wins a tie."""

    def least(q, d, at, beside):
        import numpy as np

        rank = B.ranks(order).astype(np.int64)
        tables = [np.where(rank == B.NONE, B.NONE, rank * (2 * REACH + 1) + k).astype(np.uint16) for k in range(2 * REACH + 1)]
        for eye, end in EYES:
            best = place = None
            for k, turned in enumerate(B.rotations({c: x[at] for c, x in q.items()}, REACH, (end,))):
                s = B.Side(turned, d, slice(None), beside, end, end)
                key, now = s.of(tables[k]), s.place()
                better = key < best if k else None
                best, place = (np.where(better, key, best), np.where(better, now, place)) if k else (key, now)
            hit = np.flatnonzero(best != B.NONE)
            md, hd = np.divmod(place.ravel()[hit], B.WIDTH)
            yield hit, B.said(eye, len(hit)), hd, md, best.ravel()[hit] % (2 * REACH + 1) - np.int32(REACH)

    rows = B.compared(*sides(spark, sf_dir), B.every(least), "req bigint, serial bigint, eye string, hd bigint, md bigint, rot int", B.ROWS_OUT)
    best = F.min(F.struct({"fhd": D.fhd, "nhd": D.nhd}[order](F.col("hd"), F.col("md")).alias("d"), "rot", "hd", "md")).alias("best")
    return one_row(rows, spark, sf_dir, lambda r: r.groupBy("req", "serial", "eye").agg(best).select("req", "serial", "eye", "best.hd", "best.md", "best.rot"))


_R32 = "((({c} << ((rot + 32) % 32)::INT) | ({c} >> ((32 - (rot + 32) % 32) % 64)::INT)) & 4294967295)"
ROTATED = f"""{X.CODES}, rq AS (SELECT req, eye, rot, {_R32.format(c="code")} AS code, {_R32.format(c="mask")} AS mask FROM q, (SELECT unnest(range(-3, 4)) AS rot)),
  rpairs AS (SELECT req, serial, rq.eye, rot, bit_count(xor(rq.code, d.code) & rq.mask & d.mask)::BIGINT AS hd, bit_count(rq.mask & d.mask)::BIGINT AS md FROM rq JOIN d ON rq.eye = d.eye)"""


@query("min_rotation_fhd", f"WITH {ROTATED} SELECT req, serial, eye, hd, md, rot::INT AS rot FROM rpairs WHERE md > 0 QUALIFY row_number() OVER (PARTITION BY req, serial, eye ORDER BY hd::DOUBLE / md, rot) = 1")
def min_rotation_fhd(spark, sf_dir):
    return min_rotation(spark, sf_dir, "fhd")


@query("min_rotation_nhd", f"WITH {ROTATED} SELECT req, serial, eye, hd, md, rot::INT AS rot FROM rpairs WHERE md > 0 QUALIFY row_number() OVER (PARTITION BY req, serial, eye ORDER BY (md * (20 * hd - 9 * md) + 147456 * hd)::DOUBLE / md, rot) = 1")
def min_rotation_nhd(spark, sf_dir):
    return min_rotation(spark, sf_dir, "nhd")


@query("matched_rotations", f"WITH {ROTATED} SELECT req, serial, eye, list(rot::INT ORDER BY rot) AS rotations FROM rpairs WHERE md > 0 AND hd < md * 0.345::DOUBLE GROUP BY ALL")
def matched_rotations(spark, sf_dir):
    def matched(q, d, at, beside):
        import numpy as np

        for eye, end in EYES:
            close = np.stack([B.Side(turned, d, slice(None), beside, end, end).close(D.STRICT) for turned in B.rotations({c: x[at] for c, x in q.items()}, REACH, (end,))], axis=-1).reshape(-1, 2 * REACH + 1)
            hit = np.flatnonzero(close.any(axis=1))
            yield hit, B.said(eye, len(hit)), B.lists(close[hit], np.broadcast_to(np.arange(-REACH, REACH + 1, dtype=np.int32), (len(hit), 2 * REACH + 1)))

    rows = B.compared(*sides(spark, sf_dir), B.every(matched), "req bigint, serial bigint, eye string, rotations array<int>", B.ROWS_OUT)
    return one_row(rows, spark, sf_dir, lambda r: r.groupBy("req", "serial", "eye").agg(F.sort_array(F.flatten(F.collect_list("rotations"))).alias("rotations")))


@query("int4_dot_top1", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-8, least(7, floor(x::DOUBLE * 8)))::BIGINT) AS v FROM embeddings) SELECT a.vec_id AS req, b.vec_id AS hit, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))::BIGINT AS dot FROM v a JOIN v b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dot DESC, b.vec_id) = 1")
def int4_dot_top1(spark, sf_dir):
    """The closest vector by inner product of 4-bit integers: one product of matrices a pair of blocks, exact in floats."""
    four = F.transform("embedding", lambda x: F.greatest(F.lit(-8), F.least(F.lit(7), F.floor(x.cast("double") * 8).cast("long"))).cast("byte"))
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", four.alias("v"))

    def matrix(v, width):
        """Vectors as rows, and their lengths; -1 for a missing one."""
        import numpy as np

        n = v.value_lengths().fill_null(-1).to_numpy()
        out, inside = np.zeros((len(n), width), np.float32), np.arange(width) < n[:, None]
        out[inside] = v.flatten().to_numpy()
        return out, n

    def kernel(q, d):
        import numpy as np

        if not len(d["id"]):
            return
        width = max(0, *(v.value_lengths().fill_null(0).to_numpy().max(initial=0) for v in (q["v"], d["v"])))
        (a, a_n), (b, b_n) = matrix(q["v"], width), matrix(d["v"], width)
        for at in B.strips(q, d):
            dot = a[at] @ b.T
            if len({*a_n[at], *b_n}) > 1 or a_n[0] < 0:
                dot[(a_n[at, None] != b_n) | (b_n < 0)] = -np.inf  # vectors of different lengths have no product
            best = dot.argmax(axis=1)  # rows stand in order of ids
            most = dot[np.arange(len(best)), best]
            yield [q["id"][at], d["id"][best], pa_int(most)]

    def pa_int(x):
        import numpy as np
        import pyarrow as pa

        none = np.isneginf(x)
        return pa.array(np.where(none, 0, x).astype(np.int64), mask=none)

    scored = B.compared(v.where("vec_id % 10 = 0"), v.where("vec_id % 10 <> 0"), kernel, "req bigint, hit bigint, dot bigint")
    return scored.groupBy("req").agg(F.max(F.struct("dot", (-F.col("hit")).alias("n"))).alias("b")).select("req", (-F.col("b.n")).alias("hit"), "b.dot")


@query("match_one_eye", f"{WITH} SELECT req, serial, hd_l AS hd, md_l AS md FROM wide WHERE close_l")
def match_one_eye(spark, sf_dir):
    kernel = B.matches(lambda q, d, at: ((s := B.Side(q, d, at)).close(D.STRICT), s.hd, s.md))
    return B.compared(*left_sides(spark, sf_dir), kernel, "req bigint, serial bigint, hd bigint, md bigint")


@query("match_both_and", f"{WITH} SELECT req, min(serial) AS first_match, count(*) AS n_matches FROM wide WHERE close_l AND close_r GROUP BY req")
def match_both_and(spark, sf_dir):
    return both_eyes(spark, sf_dir, both_match).groupBy("req").agg(F.min("serial").alias("first_match"), F.count(F.lit(1)).alias("n_matches"))


@query("match_or_policy", f"{WITH} SELECT req, serial, close_l, close_r, req % 20 = 1 AS use_or FROM wide WHERE CASE WHEN req % 20 = 1 THEN close_l OR close_r ELSE close_l AND close_r END")
def match_or_policy(spark, sf_dir):
    """Some requests ask for either eye, the others for both."""

    def chosen(q, d, at):
        left, right = (s.close(D.STRICT) for s in both_sides(q, d, at))
        either = q["id"][at, None] % 20 == 1
        return (left & right) | (either & (left | right)), left, right

    rows = B.compared(*sides(spark, sf_dir), B.matches(chosen), "req bigint, serial bigint, close_l boolean, close_r boolean")
    return rows.withColumn("use_or", F.col("req") % 20 == 1)


@query("prefilter_then_strict", f"{WITH} SELECT req, serial, hd_l, md_l, close_l AND close_r AS strict FROM wide WHERE md_l > 0 AND hd_l < md_l * 0.375::DOUBLE")
def prefilter_then_strict(spark, sf_dir):
    """The loose threshold on one eye first; the strict one, on both, only for what is left."""
    return both_eyes(spark, sf_dir, lambda left, right: left.close(D.LOOSE)).select("req", "serial", "hd_l", "md_l", (is_close("l") & is_close("r")).alias("strict"))


@query("one_eye_recheck", f"{WITH} SELECT req, serial, close_l, close_r, CASE WHEN close_l THEN hd_r ELSE hd_l END AS other_hd FROM wide WHERE close_l <> close_r")
def one_eye_recheck(spark, sf_dir):
    """Hits of one eye only, with the other eye's distance that the re-check asks for."""
    rows = both_eyes(spark, sf_dir, lambda left, right: left.close(D.STRICT) != right.close(D.STRICT)).withColumns({"close_l": is_close("l"), "close_r": is_close("r")})
    return rows.select("req", "serial", "close_l", "close_r", F.when(F.col("close_l"), F.col("hd_r")).otherwise(F.col("hd_l")).alias("other_hd"))


@query("intra_batch_pairs", f"WITH {X.CODES} SELECT a.req AS later, b.req AS earlier, bool_or(a.eye = 'L' AND c) AS left_match, bool_or(a.eye = 'R' AND c) AS right_match FROM (SELECT a.req, a.eye, b.req AS r2, bit_count(a.mask & b.mask) > 0 AND bit_count(xor(a.code, b.code) & a.mask & b.mask) < bit_count(a.mask & b.mask) * 0.345::DOUBLE AS c FROM q a JOIN q b ON a.eye = b.eye AND a.req > b.req) a JOIN (SELECT DISTINCT req FROM q) b ON a.r2 = b.req GROUP BY ALL HAVING bool_or(c)")
def intra_batch_pairs(spark, sf_dir):
    """Pairs within a batch, the later request against the earlier one."""

    def matched(q, d, at):
        left, right = (s.close(D.STRICT) for s in both_sides(q, d, at))
        return (left | right) & (q["id"][at, None] > d["id"]), left, right

    q = sides(spark, sf_dir)[0]
    hits = B.compared(q, q, B.matches(matched), "later bigint, earlier bigint, left_match boolean, right_match boolean")
    return hits if B.unique(q.select("req"), "req") else hits.groupBy("later", "earlier").agg(F.bool_or("left_match").alias("left_match"), F.bool_or("right_match").alias("right_match"))


def nearest(spark, sf_dir, k: int, down: bool = False) -> DataFrame:
    """The ``k`` nearest left codes of each request, by fraction, then serial; with ``down`` the furthest."""
    found = B.k_nearest(*left_sides(spark, sf_dir), k, down=down)
    return found.select("req", "serial", "hd", "md", F.col("rank").cast("long").alias("rank"))


LEFT = "(SELECT req, serial, hd, md FROM pairs WHERE eye = 'L' AND md > 0)"


@query("knn_exact", f"WITH {X.CODES} SELECT *, {WINDOW_K} AS rank FROM {LEFT} QUALIFY rank <= 8")
def knn_exact(spark, sf_dir):
    return nearest(spark, sf_dir, 8)


@query("knn_truncated", f"WITH {X.CODES}, k AS (SELECT *, {WINDOW_K} AS rank FROM {LEFT} QUALIFY rank <= 8) SELECT * FROM k WHERE rank <= 3")
def knn_truncated(spark, sf_dir):
    """A list of 8 neighbours cut to 3."""
    return nearest(spark, sf_dir, 8).where("rank <= 3")


@query("argmin", f"WITH {X.CODES} SELECT * FROM {LEFT} QUALIFY {WINDOW_K} = 1")
def argmin(spark, sf_dir):
    return nearest(spark, sf_dir, 1).drop("rank")


@query("furthest", f"WITH {X.CODES} SELECT * FROM {LEFT} QUALIFY row_number() OVER (PARTITION BY req ORDER BY hd::DOUBLE / md DESC, serial) = 1")
def furthest(spark, sf_dir):
    return nearest(spark, sf_dir, 1, down=True).drop("rank")


@query("topk_truncated_with_count", f"{WITH} SELECT req, count(*) AS n_matches, list(serial ORDER BY serial)[1:4] AS partial FROM wide WHERE close_l GROUP BY req")
def topk_truncated_with_count(spark, sf_dir):
    """The count of all matches beside a list of the first few; a block gives its count and its own first few."""

    def kernel(q, d):
        import numpy as np

        for at in B.strips(q, d) if len(d["id"]) else ():
            close = B.Side(q, d, at).close(D.STRICT)
            first = [np.flatnonzero(row)[:4] for row in close]
            some = np.array([len(x) > 0 for x in first])
            marked = np.arange(4) < np.array([len(x) for x in first])[:, None]
            places = np.zeros((len(first), 4), np.int64)
            places[marked] = np.concatenate(first)
            yield [q["id"][at][some], np.count_nonzero(close, axis=1)[some], B.lists(marked[some], d["id"][places[some]])]

    found = B.compared(*left_sides(spark, sf_dir), kernel, "req bigint, n bigint, first array<bigint>")
    return found.groupBy("req").agg(F.sum("n").alias("n_matches"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, 4).alias("partial"))


@query("match_counters", f"WITH {X.CODES} SELECT req, eye, count(*) AS n FROM pairs WHERE md > 0 AND hd < md * 0.345::DOUBLE GROUP BY ALL")
def match_counters(spark, sf_dir):
    n = B.compared(*sides(spark, sf_dir), B.counts(lambda q, d, at: [s.close(D.STRICT) for s in both_sides(q, d, at)]), "req bigint, l bigint, r bigint")
    each = n.groupBy("req").agg(F.sum("l").alias("L"), F.sum("r").alias("R"))
    return each.unpivot("req", ["L", "R"], "eye", "n").where("n > 0")
