"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

Darts are the points of a Poisson process over (element, weight, rank) that a hash fixes once for all sets. A set's darts
are the ones inside the regions [0, weight) x [0, theta) of its elements; each dart belongs to one of ``COORDINATES``
coordinates, and a signature keeps the dart of the lowest rank in each. Two sets share that dart with a probability equal
to their weighted Jaccard similarity. With theta = t / total weight, t = k ln k + 2k, a set gets about t darts however
large it is; sets with an empty coordinate throw again with theta doubled, which leaves the darts found so far in place.

Signatures are cut into bands. Texts that share a band meet in a bucket, where candidates are compared exactly. A small
bucket compares its pairs. In a large one all rows are compared with one pivot, and what sets them apart from it tells
which other pairs can still be similar: with D(x) the symmetric difference of x and the pivot, x and y differ by just
D(x) ^ D(y), so similar ones need |D(x) & D(y)| >= (|D(x)| + |D(y)| - c(|x| + |y|)) / 2 with c = (1 - s) / (1 + s). Rows that
are similar to the pivot are one class, so one of the two isn't, and its D is large: the two must share a good part of
their differences. That is a join of small sets with a known overlap: differences are ordered from rare to frequent, a
prefix of them makes the next buckets, and a pair is compared only if the places at which it meets leave room for the
overlap. Buckets of a pivot's neighbours are merged, so the work follows the number of rows, not of pairs; buckets that are
still large take a pivot of their own, until none is left. No pair that shares a band and is similar is passed over unless
both sides are in one class already. Links and classes stay distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import WORDS, mixed
from .common import release, slices, stage, table, text_of

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 5: a pair at similarity 0.8 is missed with probability (1 - 0.8**5) ** 32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
COORDINATES = BANDS * BAND_ROWS
#: Rows of a band's bucket, and of a bucket of differences, up to which pairs are looked at directly: work per row is bounded.
SMALL, SMALL_NEXT = 8, 1024
#: Comparisons with one pivot that a task takes; a pivot with more has copies of its set in several tasks.
FAN = 512
#: Rows of two numbers that may be broadcast: about 32 MB. Larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def shingles(words: list[bytes], size: int = SHINGLE):
    """The distinct shingle hashes of a text and how often each occurs; a shorter text is one shingle."""
    import numpy as np

    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = np.fromiter(map(WORDS.__getitem__, words), np.int64, len(words)).astype(np.uint64)
    with np.errstate(over="ignore"):
        spread = [mixed(ids, 3 + k) for k in range(min(size, len(words)))]
        n = max(1, len(words) - size + 1)
        sums = spread[0][:n].copy()
        for k in range(1, len(spread)):
            sums += spread[k][k : k + n]
    return np.unique(mixed(sums, min(len(words), size)), return_counts=True)


def signatures(sets: list, weights: list, k: int = COORDINATES):
    """One row of ``k`` dart ids (uint64) for each set of element hashes; empty sets get zeros.

    Weights may be any positive numbers. In the layer [l - 1, l) of an element's weight, darts arrive along the rank
    axis at hashed exponential steps; one counts if its hashed place in the layer is below the weight.
    """
    import numpy as np

    out = np.zeros((len(sets), k), np.uint64)
    todo = [i for i, s in enumerate(sets) if len(s)]
    t = k * math.log(k) + 2 * k
    while todo:
        element, owner, layer, room, theta = [], [], [], [], []
        for j, i in enumerate(todo):
            w = np.asarray(weights[i], float)
            layers = np.ceil(w).astype(np.int64)
            of = np.repeat(np.arange(len(w)), layers)
            level = np.arange(len(of)) - np.repeat(np.cumsum(layers) - layers, layers)
            element.append(np.asarray(sets[i], np.uint64)[of])
            owner.append(np.full(len(of), j))
            layer.append(level.astype(np.uint64))
            room.append(np.minimum(w[of] - level, 1))
            theta.append(np.full(len(of), t / w.sum()))
        element, owner, layer, room, theta = map(np.concatenate, (element, owner, layer, room, theta))
        with np.errstate(over="ignore"):
            base = mixed(element + mixed(layer, 11), 12)
        rank, found, step = np.zeros(len(base)), [], 0
        while len(base):
            with np.errstate(over="ignore"):
                dart = mixed(base + np.uint64(step + 1) * np.uint64(0xD1342543DE82EF95), 13)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
            live = rank < theta
            base, owner, room, theta, rank, dart = base[live], owner[live], room[live], theta[live], rank[live], dart[live]
            inside = (mixed(dart, 14) >> np.uint64(11)).astype(float) / (1 << 53) < room
            found.append((owner[inside], rank[inside], dart[inside]))
            step += 1
        owner, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        cell = owner * k + (mixed(dart, 15) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
        best = np.zeros(len(todo) * k, np.uint64)
        filled = np.zeros(len(todo) * k, bool)
        best[cell[first]], filled[cell[first]] = mixed(dart[first], 16), True
        done = filled.reshape(-1, k).all(axis=1)
        best = best.reshape(-1, k)
        for j, i in enumerate(todo):
            if done[j]:
                out[i] = best[j]
        todo, t = [i for j, i in enumerate(todo) if not done[j]], 2 * t
    return out


def band_hashes(signature, bands: int = BANDS):
    """A hash for each band of each signature."""
    import numpy as np

    parts = signature.reshape(len(signature), bands, -1)
    sums = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(parts.shape[2]):
            sums = mixed(sums.ravel() + parts[:, :, r].ravel(), 20 + r).reshape(sums.shape)
        sums = mixed((sums + np.arange(bands, dtype=np.uint64)).ravel(), 40).reshape(sums.shape)
    return sums.astype(np.int64)


def described(docs: DataFrame, weighting: str) -> DataFrame:
    """``doc_id, tkey, k1, k2, bands`` for each row; k1 and k2 stand for the sequence of lower-case words."""
    schema = "doc_id bigint, tkey bigint, k1 bigint, k2 bigint, bands array<bigint>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            for part in slices(b, 2):
                texts = [words_of(raw) for raw in part.column(2).to_pylist()]
                keys = [divmod(xxhash.xxh3_128_intdigest(b" ".join(w)), 1 << 64) for w in texts]
                once: dict = {}
                for n, key in enumerate(keys):
                    once.setdefault(key, n)
                place = {key: j for j, key in enumerate(once)}
                sets = [shingles(texts[n]) for n in once.values()]
                weights = [c if weighting == "count" else np.ones(len(s)) for s, c in sets]
                bands = band_hashes(signatures([s for s, _ in sets], weights))[[place[key] for key in keys]]
                full = np.array([len(w) > 0 for w in texts])
                ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                columns = [pa.array([k[j] - (1 << 63) for k in keys], pa.int64()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[full].ravel()))], names=["doc_id", "tkey", "k1", "k2", "bands"])
        release()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("tkey"), text_of().cast("binary").alias("raw"))
    return plain.mapInArrow(run, schema)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows (counted here); else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shingle_sets(docs: DataFrame, wanted: DataFrame, weighting: str) -> DataFrame:
    """``node, shingles``: the sorted shingle hashes (32 bits) of the nodes in ``wanted``, as bytes.

    If shingles weigh by their count, the n-th time of a shingle is an element of its own, which makes a bag a set.
    ``wanted`` has ``doc_id, tkey, node``, one row of the documents for each node.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("tkey"), text_of().cast("binary").alias("raw")).alias("d")
    small = small_or_shuffled(wanted).alias("w")
    rows = plain.join(small, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tkey") == F.col("w.tkey"))).select("node", "raw")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part in slices(b, 1):
                sets = []
                for raw in part.column(1).to_pylist():
                    s, c = shingles(words_of(raw))
                    if weighting == "count" and len(s) and c.max() > 1:
                        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                        with np.errstate(over="ignore"):
                            s = np.where(nth > 0, mixed(np.repeat(s, c) + nth.astype(np.uint64), 60), np.repeat(s, c))
                    sets.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        release()

    return rows.mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """For each pair ``a, b, star``: ``link`` (similar or not), the sizes ``size`` and ``other``, ``apart``.

    ``apart`` is filled for comparisons with a pivot: the shingles that only one of both has. A pivot that many rows are
    compared with has copies of its set, so that no task gets all of them.
    """
    fans = pairs.where("star").groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("copies")).where("copies > 1")
    fans = small_or_shuffled(stage(fans, "fans"))
    left = pairs.join(fans, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    heads = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(fans, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"))
    rows = left.join(own, "a").join(heads, ["b", "salt"]).select("a", "b", "star", "x", "y")

    def look(x: bytes, y: bytes, star: bool):
        import numpy as np

        a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        inter = len(np.intersect1d(a, b, assume_unique=True))
        apart = np.setxor1d(a, b, assume_unique=True).tolist() if star else []
        return inter >= similarity * (len(a) + len(b) - inter), len(a), len(b), apart

    schema = "a bigint, b bigint, star boolean, link boolean, size bigint, other bigint, apart array<bigint>"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for b in batches:
            for part in slices(b, 3):
                found = [look(x, y, k) for x, y, k in zip(*[part.column(c).to_pylist() for c in (3, 4, 2)], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=[x.split()[0] for x in schema.split(", ")])
        release()

    return rows.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the least node of the connected component.

    Every root hooks on to its least neighbour, chains of hooks are halved until they are flat, and the edges between
    roots that are left go into the next step; each step at least halves the roots that have edges.
    """
    edges = stage(edges.select("a", "b").distinct(), "edges")
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = None
    while not edges.isEmpty():
        ways = edges.select("a", "b").union(edges.select("b", "a"))
        hooks = stage(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = stage(hooks.join(up, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "jumped")
            hooks, moved = jumped.select("node", "label"), not jumped.where("moved").isEmpty()
            if not moved:
                break
        labels = hooks if labels is None else stage(relabelled(labels, "label", hooks), "labels")
        edges = stage(relabelled(relabelled(edges, "a", hooks), "b", hooks).where("a <> b").distinct(), "edges")
    return both.withColumn("label", F.col("node")).limit(0) if labels is None else labels


def relabelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its label where it has one."""
    to = labels.select(F.col("node").alias(column), F.col("label").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).select(df.columns)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` after the classes that ``links`` connect have become one; only links between classes are worked on."""
    if labels is not None:
        links = relabelled(relabelled(links, "a", labels), "b", labels).where("a <> b").distinct()
    links = stage(links, "new")
    if links.isEmpty():
        return labels
    found = components(links)
    return found if labels is None else stage(relabelled(labels, "label", found).unionByName(found.join(labels.select("node"), "node", "left_anti")), "merged")


def linked(active: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """``node, label`` of the classes of more than one node in the buckets ``active(bucket, node)``; None without any."""
    sizes = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    weights = stage(active.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    head = lambda: F.max(F.struct("weight", (-F.col("node")).alias("m")))
    weighed = stage(active.join(weights, "node"), "weighed")
    heads = stage(weighed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), head().alias("head")), "heads")
    # Buckets around one text agree on its most connected neighbour as their pivot, whether it is in them or not.
    wide = weighed.join(heads.where(F.col("n") > SMALL), "bucket").select("bucket", "node", "head")
    hubs = wide.groupBy("node").agg(F.max("head").alias("hub"))
    pivots = wide.join(hubs, "node").groupBy("bucket").agg((-F.max("hub")["m"]).alias("pivot"))
    rows = weighed.join(pivots, "bucket", "left").select(
        "bucket", "node", F.col("node").alias("label"), "pivot", F.lit(False).alias("near"), F.lit(False).alias("cross"), F.lit(0).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("apart"), F.lit(0).cast("bigint").alias("size")
    )
    labels, rows, c = None, stage(rows, "rows"), (1 - similarity) / (1 + similarity)
    while not rows.isEmpty():
        star = rows.where("pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct().withColumn("star", F.lit(True))
        few = rows.where("pivot IS NULL").drop("pivot")
        other = few.select("bucket", *[F.col(x).alias(f"{x}2") for x in ("node", "label", "near", "left", "apart", "size")])
        # `left` is how many differences a row has from its place in the bucket on; the pair can share no more than that.
        room = F.least("left", "left2") >= (F.col("apart") + F.col("apart2") - F.lit(c) * (F.col("size") + F.col("size2"))) / 2 - 1e-6
        meet = few.join(other, "bucket").where("node < node2 AND label <> label2 AND NOT (near AND near2) AND (NOT cross OR near <> near2)").where(room)
        pairs = stage(star.union(meet.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().withColumn("star", F.lit(False))), "pairs")
        looks = stage(compared(pairs, sets, similarity), "looks")
        labels = merged(labels, looks.where("link").select("a", "b"))
        rows = stage(following(rows.where("pivot IS NOT NULL"), looks.where("star"), labels, weights, similarity), "rows")
    return labels


def following(rows: DataFrame, looks: DataFrame, labels: DataFrame | None, weights: DataFrame, similarity: float) -> DataFrame:
    """The buckets of differences in which rows that were compared with a pivot go on, in the columns of ``rows``."""
    c = (1 - similarity) / (1 + similarity)
    now = lambda df, name: df if labels is None else relabelled(df, name, labels)
    # Buckets that are of one class by now are done, and so are comparisons that no other bucket needs.
    held = now(rows.select("bucket", "node", "pivot", F.col("node").alias("label")), "label")
    open_ones = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    needed = held.join(open_ones, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    at = stage(now(looks.join(needed, ["a", "b"]).withColumn("label", F.col("a")), "label").withColumn("of", F.size("apart").cast("bigint")), "at")
    each = at.select("a", "b", "label", "link", F.explode("apart").alias("key"))
    often = each.groupBy("b", "key").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("link").alias("every")).where("low <> high AND NOT every").select("b", "key", "f")
    # Differences that no pair to be found can share come first in the order; the others follow by how many rows have them.
    shared = each.join(often, ["b", "key"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("keys"))
    near, excess = (F.col("of") - c * (F.col("size") - F.col("other"))) / 2, F.col("of") - c * (F.col("size") + F.col("other"))
    needs = lambda v: F.greatest(F.lit(1), F.floor(v + 1e-9) + 1)  # noqa: E731  the overlap is more than v
    ordered = at.drop("apart").join(shared, ["a", "b"]).withColumns({"need": F.when(F.col("link"), needs(near)).otherwise(needs(excess / 2)), "need_far": F.when(~F.col("link"), needs(c * F.col("other") + excess / 2))})
    # Two rows far from the pivot need more in common, so a shorter prefix does; they have buckets of their own.
    entries = F.transform("keys", lambda e, i: F.struct(e["key"].alias("key"), (F.size("keys") - i).cast("bigint").alias("left")))
    prefix = lambda cross, need: F.transform(F.filter(entries, lambda e: e["left"] >= F.col(need)), lambda e: F.struct(e["key"].alias("key"), e["left"].alias("left"), F.lit(cross).alias("cross")))
    going = F.concat(prefix(True, "need"), F.when(F.col("link"), F.array().cast("array<struct<key:bigint,left:bigint,cross:boolean>>")).otherwise(prefix(False, "need_far")))
    placed = ordered.select(F.col("a").alias("node"), "b", "label", F.col("link").alias("near"), F.col("of").alias("apart"), "size", F.inline(going))
    goes = placed.select(F.xxhash64("b", "key", "cross").alias("bucket"), "node", "label", "near", "cross", "left", "apart", "size")
    goes = stage(goes.join(weights, "node"), "goes")
    about = goes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("near").alias("some"), F.min("near").alias("every"), F.any_value("cross").alias("crossing"), F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("head")).where("low <> high AND (NOT crossing OR (some AND NOT every))")
    return goes.join(about.select("bucket", F.when(F.col("n") > SMALL_NEXT, -F.col("head.m")).alias("pivot")), "bucket").select("bucket", "node", "label", "pivot", "near", "cross", "left", "apart", "size")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "count") -> DataFrame:
    """Classes of near-duplicate texts: ``doc_id, tkey, class_id, class_tkey, class_size``, a row for each row of ``docs``.

    Texts are one class if links of weighted Jaccard similarity ``similarity`` or more over their five-word shingles,
    each weighing as often as it occurs (once, with ``weighting="set"``), connect them; case of A-Z and spacing don't count. ``class_id`` is the least id of the
    class (nulls last) and ``class_tkey`` the hash of that row's text; (class_id, class_tkey) names the row to keep.

    Texts of fewer than five words are one shingle. Null and empty texts, without any word, are copies of each other.
    Rows with a null id are classed by their text. Repeated rows are in one class. Empty table: no rows. Other columns
    are not read.
    """
    rows = stage(described(docs, weighting), "described")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    texts = rows.groupBy("k1", "k2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands"))
    nodes = stage(texts.select("k1", "k2", "first", "n", "bands", F.monotonically_increasing_id().alias("node")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    active = stage(banded.join(shared, "bucket").select("bucket", "node"), "buckets")
    wanted = nodes.join(active.select("node").distinct(), "node").select("first.doc_id", "first.tkey", "node")
    sets = stage(shingle_sets(docs, wanted, weighting), "sets")
    labels = linked(active, sets, similarity)
    known = nodes.select("k1", "k2", "first", "n", "node")
    if labels is not None:
        known = relabelled(known, "node", labels)
    known = stage(known, "known")
    classes = known.groupBy("node").agg(F.min("first").alias("class"), F.sum("n").alias("class_size"))
    placed = known.select("k1", "k2", "node").join(classes, "node").drop("node")
    return rows.select("doc_id", "tkey", "k1", "k2").join(placed, ["k1", "k2"]).select("doc_id", "tkey", F.col("class.doc_id").alias("class_id"), F.col("class.tkey").alias("class_tkey"), "class_size")


def without_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "count") -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``, in all their columns."""
    classes = stage(near_duplicates(docs, similarity, weighting), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("class_tkey"))
    gone = small_or_shuffled(classes.where(~stays).select("doc_id", "tkey").distinct()).alias("g")
    again = small_or_shuffled(classes.where(stays).groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")).alias("r")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("tkey")).alias("d")
    same = lambda x: F.col("d.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("d.tkey") == F.col(f"{x}.tkey"))
    left = own.join(gone, same("g"), "left_anti")
    repeated = left.join(again, same("r"), "left_semi").groupBy("doc_id", "tkey").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return left.join(again, same("r"), "left_anti").select("row").union(repeated).select("row.*")


def op5_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
