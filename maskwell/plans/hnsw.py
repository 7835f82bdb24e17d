"""A layered neighbour graph with frontier search, insertion and compaction on DataFrames.

A search keeps, for every query of a bounded batch, the ``ef`` nearest nodes seen so far. A round opens all of them that
aren't open yet: one join with the edges, one with the codes, one top-``ef``; it ends when nothing new is near enough.
Rounds follow the graph's diameter, not its size, and their lineage is cut. Insertion searches all new nodes of a batch
against the graph as it was, links them both ways and compacts neighbourhoods over the limit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import distance as D
from ..operators.graphs import beyond_nearest
from ..registry import query
from ..sources import fixtures as X
from .index import layer_of


@dataclass(frozen=True)
class Params:
    """Neighbours of a new node, the limit of a neighbourhood (twice as many at the bottom), list sizes, layer base."""

    m: int = 12
    ef_construction: int = 32
    ef_search: int = 32
    base: int = 8

    def limit(self, layer):
        return F.when(layer == 0, 4 * self.m).otherwise(2 * self.m)


@dataclass(frozen=True)
class Graph:
    """``codes(serial, code, mask, layer)``, with the top layer of each node, and ``edges(layer, src, dst)``."""

    codes: DataFrame
    edges: DataFrame
    params: Params = Params()

    def entry(self) -> DataFrame:
        """One row: the lowest id of the highest layer."""
        return self.codes.agg(F.min(F.struct((-F.col("layer")).alias("down"), "serial")).alias("e")).select("e.serial", (-F.col("e.down")).alias("top"))

    def top(self) -> int:
        return self.codes.agg(F.max("layer")).first()[0] or 0

    def opened(self, found: DataFrame, layer: int) -> DataFrame:
        """Neighbours of the nodes that aren't open yet, each once a query and not among those found."""
        links = self.edges.where(F.col("layer") == layer).select(F.col("src").alias("serial"), "dst")
        near = found.where("NOT opened").join(links, "serial").select("req", F.col("dst").alias("serial")).distinct()
        return near.join(found.select("req", "serial"), ["req", "serial"], "left_anti")

    def distances(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        q = X.bounded(queries.select("req", F.col("code").alias("q_code"), F.col("mask").alias("q_mask")))
        hd, md = D.hd_md(F.col("q_code"), F.col("q_mask"), F.col("code"), F.col("mask"))
        return pairs.join(self.codes.select("serial", "code", "mask"), "serial").join(q, "req").select("req", "serial", D.fhd(hd, md).alias("dist")).where("dist IS NOT NULL")

    def search_layers(self, queries: DataFrame, ef: int, down_to: int = 0) -> dict[int, DataFrame]:
        """The ``ef`` nearest found for each query in each layer: ``req, serial, dist``."""
        order = Window.partitionBy("req").orderBy("dist", "serial")
        start = queries.select("req").crossJoin(F.broadcast(self.entry().select("serial")))  # one entry point
        found = X.cut(self.distances(start, queries).withColumn("opened", F.lit(False)))
        layers: dict[int, DataFrame] = {}
        for layer in range(self.top(), down_to - 1, -1):
            found = found.withColumn("opened", F.lit(False))
            while True:
                new = self.distances(self.opened(found, layer), queries).withColumn("opened", F.lit(False))
                best = found.withColumn("opened", F.lit(True)).unionByName(new).withColumn("k", F.row_number().over(order)).where(F.col("k") <= ef).drop("k")
                found = X.cut(best)
                if found.where("NOT opened").isEmpty():
                    break
            layers[layer] = found.select("req", "serial", "dist")
        return layers

    def search(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """``req, serial, dist, rank``: the ``k`` nearest that the walk finds, ties by serial."""
        found = self.search_layers(queries, max(k, ef or self.params.ef_search))[0]
        rank = F.row_number().over(Window.partitionBy("req").orderBy("dist", "serial"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def compacted(self, edges: DataFrame) -> DataFrame:
        """``edges`` without those that a neighbourhood over its limit drops."""
        end = lambda name: self.codes.select(F.col("serial").alias(name), F.col("code").alias(f"{name}_code"), F.col("mask").alias(f"{name}_mask"))
        hd, md = D.hd_md(F.col("src_code"), F.col("src_mask"), F.col("dst_code"), F.col("dst_mask"))
        rows = X.cut(edges.distinct().join(end("src"), "src").join(end("dst"), "dst").select("layer", "src", "dst", D.fhd(hd, md).alias("dist")))
        kept, m = rows, self.params.m
        for bottom, most in ((True, 4 * m), (False, 2 * m)):
            of = rows.where((F.col("layer") == 0) == bottom)
            kept = kept.join(beyond_nearest(of, F.col("dist"), most, most), ["layer", "src", "dst"], "left_anti")
        return X.cut(kept.select("layer", "src", "dst"))

    def insert(self, new: DataFrame) -> Graph:
        """The graph with a batch of nodes ``serial, code, mask`` inserted; their layers follow from their ids."""
        batch = X.cut(new.select("serial", "code", "mask", layer_of(F.col("serial"), self.params.base).alias("layer")))
        if self.codes.isEmpty():
            return ideal(batch, self.params)
        queries = batch.withColumnRenamed("serial", "req")
        links = []
        order = Window.partitionBy("req").orderBy("dist", "serial")
        for layer, found in self.search_layers(queries, self.params.ef_construction).items():
            near = found.join(queries.where(F.col("layer") >= layer).select("req"), "req").withColumn("k", F.row_number().over(order)).where(F.col("k") <= self.params.m)
            links.append(near.select(F.lit(layer).cast("long").alias("layer"), F.col("req").alias("src"), F.col("serial").alias("dst")))
        made = links[0]
        for part in links[1:]:
            made = made.union(part)
        both = made.union(made.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst")))
        grown = replace(self, codes=X.cut(self.codes.unionByName(batch)))
        return replace(grown, edges=grown.compacted(self.edges.unionByName(both)))

    def delete(self, gone: DataFrame) -> Graph:
        """The graph without some serials; edges to them go, too."""
        ids = gone.select("serial")
        edges = self.edges.join(ids.withColumnRenamed("serial", "src"), "src", "left_anti").join(ids.withColumnRenamed("serial", "dst"), "dst", "left_anti")
        return replace(self, codes=X.cut(self.codes.join(ids, "serial", "left_anti")), edges=X.cut(edges.select("layer", "src", "dst")))


def ideal(codes: DataFrame, params: Params = Params()) -> Graph:  # noqa: B008
    """The graph of exact nearest neighbours in each layer, linked both ways; for a bounded first batch and as a yardstick."""
    graph = Graph(codes, codes.select(F.lit(0).cast("long").alias("layer"), F.col("serial").alias("src"), F.col("serial").alias("dst")).limit(0), params)
    made = nearest_in_layers(codes, graph.top(), params.m)
    return replace(graph, edges=graph.compacted(made.union(made.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst")))))


def nearest_in_layers(codes: DataFrame, top: int, k: int) -> DataFrame:
    """``layer, src, dst``: the exact ``k`` nearest of each node among the members of each layer; quadratic, by pairs of blocks."""
    made = None
    for layer in range(top + 1):
        member = codes.where(F.col("layer") >= layer)
        near = B.k_nearest(member.withColumnRenamed("serial", "req"), member, k, itself=False)
        part = near.select(F.lit(layer).cast("long").alias("layer"), F.col("req").alias("src"), F.col("serial").alias("dst"))
        made = part if made is None else made.union(part)
    return made


def left_codes(spark, sf_dir) -> DataFrame:
    return X.eyes(spark, sf_dir).select("serial", F.col("code_l").alias("code"), F.col("mask_l").alias("mask"))


def built(spark, sf_dir) -> Graph:
    """The database's left codes: three quarters as a first batch, the rest inserted into its graph."""
    codes = X.cut(X.database(left_codes(spark, sf_dir)))
    first = codes.where("serial % 4 <> 2").withColumn("layer", layer_of(F.col("serial"), Params().base))
    return ideal(X.cut(first)).insert(codes.where("serial % 4 = 2"))


@query("layer_ideal", f"WITH {X.CODES} SELECT layer, a.serial AS src, b.serial AS dst FROM d a JOIN d b ON a.eye = 'L' AND b.eye = 'L' AND a.serial <> b.serial JOIN (SELECT unnest([0, 1]) AS layer) l ON layer = 0 OR a.serial % 8 = 0 AND b.serial % 8 = 0 WHERE bit_count(a.mask & b.mask) > 0 QUALIFY row_number() OVER (PARTITION BY layer, a.serial ORDER BY bit_count(xor(a.code, b.code) & a.mask & b.mask)::DOUBLE / bit_count(a.mask & b.mask), b.serial) <= 4")
def layer_ideal(spark, sf_dir):
    """The exact four nearest of each node among the members of its layer: the yardstick of a built graph, quadratic by nature."""
    codes = X.database(left_codes(spark, sf_dir)).withColumn("layer", (F.col("serial") % 8 == 0).cast("int"))
    return nearest_in_layers(X.cut(codes), 1, 4).withColumn("layer", F.col("layer").cast("int"))


@query("hnsw_search")
def hnsw_search(spark, sf_dir):
    """The three nearest by graph search, in a graph that was partly built by insertion; judged by recall in the tests."""
    return built(spark, sf_dir).search(X.requests(left_codes(spark, sf_dir)), 3).select("req", "serial", "dist", "rank")


@query("identity_update_search", f"WITH {X.CODES} SELECT req, serial, row_number() OVER (PARTITION BY req ORDER BY hd::DOUBLE / md, serial)::INT AS rank FROM pairs WHERE eye = 'L' AND md > 0 AND req % 30 = 1 QUALIFY rank <= 4")
def identity_update_search(spark, sf_dir):
    """Identity updates look for neighbours with the centre rotation alone, and for no match."""
    codes = left_codes(spark, sf_dir)
    return B.k_nearest(X.requests(codes).where("req % 30 = 1"), X.database(codes), 4).select("req", "serial", "rank")


@query("match_inclusive", f"WITH {X.CODES} SELECT req, serial, eye FROM pairs WHERE 1000 * hd <= 345 * md")
def match_inclusive(spark, sf_dir):
    """The secret-shared rule keeps what is not greater than the threshold, in whole numbers, equality and empty masks included."""
    from ..operators.matching import eye_pairs

    return eye_pairs(spark, sf_dir, lambda s: 1000 * s.hd.astype("int32") <= 345 * s.md.astype("int32")).select("req", "serial", "eye")
