"""Street graph from map ways and nodes.

ways: id, tags (map), nodes (array of node ids). nodes: id, lat, lon. Segments: way, stretch, seg, a, b, length_m,
kmh, grp, two_way. Edges: src, dst, base_ds, length_m, grp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields import config
from travelfields.functions import tags as T
from travelfields.functions.geo import distance_m
from travelfields.operators.components import connected_components
from travelfields.operators.indexing import dense_index
from travelfields.shared import write_shared


def road_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.ROAD_CLASSES, "highway string, class_kmh int, grp int")


def filter_drivable(ways: DataFrame) -> DataFrame:
    """Ways of a known road class, with highway, class_kmh and grp. The class table has 13 rows."""
    return ways.withColumn("highway", F.col("tags")["highway"]).join(F.broadcast(road_classes(ways.sparkSession)), "highway")


def describe_ways(ways: DataFrame) -> DataFrame:
    """Drivable, not private ways: id, nodes, highway, grp, oneway and kmh."""
    open_ways = filter_drivable(ways).where(~T.is_private(F.col("tags")))
    return open_ways.select(
        "id", "nodes", "highway", "grp", T.oneway(F.col("tags"), F.col("highway")).alias("oneway"), T.freeflow_speed(F.col("tags"), F.col("class_kmh")).alias("kmh")
    )


def way_refs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, ref, lat, lon): references that have coordinates, renumbered over gaps, of ways that keep two or more."""
    refs = ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("raw", "ref"))
    here = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    of_way = W.partitionBy("way")
    return (
        here.withColumn("n", F.count("*").over(of_way)).where("n >= 2")
        .select("way", (F.row_number().over(of_way.orderBy("raw")) - 1).alias("pos"), "ref", "lat", "lon")
    )


def missing_refs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: references without coordinates, and how many distinct nodes they name."""
    refs = ways.select(F.explode("nodes").alias("ref"))
    return refs.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").agg(F.count("*").alias("missing"), F.count_distinct("ref").alias("missing_nodes"))


def node_usage(refs: DataFrame) -> DataFrame:
    """(ref, uses, shared): occurrences, so a closed loop shares its joint with itself."""
    return refs.groupBy("ref").agg(F.count("*").alias("uses")).withColumn("shared", F.col("uses") > 1)


def step_lengths(refs: DataFrame) -> DataFrame:
    """refs with step_m, the metres from the reference before; null at the first."""
    line = W.partitionBy("way").orderBy("pos")
    return refs.withColumn("step_m", distance_m(F.lag("lat").over(line), F.lag("lon").over(line), F.col("lat"), F.col("lon")))


def cut_segments(refs: DataFrame, max_m: float = config.MAX_SEGMENT_M) -> DataFrame:
    """(way, stretch, seg, a, b, length_m, kept): ways cut at shared nodes, at their end, and where the length since the last
    cut reaches max_m. kept is false for segments between equal nodes or of 0.5 m and less.

    A shared node always resets the length, so ways are first split there by a window; the fold with reset then runs
    over the steps of one stretch only."""
    steps = step_lengths(refs).join(node_usage(refs).select("ref", "shared"), "ref")
    line = W.partitionBy("way").orderBy("pos")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("prev", F.lag("ref").over(line)).withColumn(
        "stretch", F.coalesce(F.sum(F.when(F.col("shared") & (F.col("pos") > 0), 1).otherwise(0)).over(before), F.lit(0)).cast("int")
    ).where("pos > 0")
    grouped = steps.groupBy("way", "stretch").agg(F.sort_array(F.collect_list(F.struct("pos", "prev", "ref", "step_m"))).alias("steps"))
    kind = "array<struct<a:long,b:long,m:double>>"
    start = F.struct(F.element_at("steps", 1)["prev"].cast("long").alias("a"), F.lit(0.0).alias("m"), F.array().cast(kind).alias("out"))

    def fold(acc, s):
        m = acc["m"] + s["step_m"]
        cut = m >= max_m
        done = F.array(F.struct(acc["a"].alias("a"), s["ref"].cast("long").alias("b"), m.alias("m")))
        return F.struct(F.when(cut, s["ref"].cast("long")).otherwise(acc["a"]).alias("a"), F.when(cut, 0.0).otherwise(m).alias("m"), F.when(cut, F.concat(acc["out"], done)).otherwise(acc["out"]).alias("out"))

    end = F.element_at("steps", -1)["ref"].cast("long")

    def finish(acc):
        rest = F.array(F.struct(acc["a"].alias("a"), end.alias("b"), acc["m"].alias("m")))
        # The last step closed a segment exactly when nothing has been walked since.
        return F.when((F.size(acc["out"]) > 0) & (F.element_at(acc["out"], -1)["b"] == end) & (acc["m"] == 0) & (acc["a"] == end) & acc["closed"], acc["out"]).otherwise(F.concat(acc["out"], rest))

    def fold_closed(acc, s):
        nxt = fold(acc, s)
        return F.struct(nxt["a"].alias("a"), nxt["m"].alias("m"), nxt["out"].alias("out"), ((acc["m"] + s["step_m"]) >= max_m).alias("closed"))

    start = F.struct(start["a"].alias("a"), start["m"].alias("m"), start["out"].alias("out"), F.lit(False).alias("closed"))
    cuts = grouped.withColumn("cuts", F.aggregate("steps", start, fold_closed, finish))
    return cuts.select("way", "stretch", F.posexplode("cuts").alias("seg", "c")).select(
        "way", "stretch", "seg", F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.col("c.m").alias("length_m"), ((F.col("c.a") != F.col("c.b")) & (F.col("c.m") > 0.5)).alias("kept")
    )


def orient_segments(cuts: DataFrame, ways: DataFrame) -> DataFrame:
    """Kept segments with speed, group and direction; ends are swapped where the way runs against its order."""
    rules = ways.select(F.col("id").alias("way"), "oneway", "kmh", "grp")
    back = F.col("oneway") == -1
    return cuts.where("kept").join(rules, "way").select(
        "way", "stretch", "seg", F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"), "length_m", "kmh", "grp", (F.col("oneway") == 0).alias("two_way")
    )


def largest_component(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of the component with most nodes (ties: smallest node id), and one row: components, nodes, share. Sizes are
    counted with map-side combine; the winner alone goes to every task."""
    labels = write_shared(connected_components(segments.select("a", "b")), "graph-labels")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")
    kept = segments.join(inside.withColumnRenamed("node", "a"), "a", "left_semi").join(inside.withColumnRenamed("node", "b"), "b", "left_semi")
    report = sizes.agg(F.count("*").alias("components"), F.max("n").alias("nodes"), (F.max("n") / F.sum("n")).alias("share"))
    return kept, report


def directed_edges(segments: DataFrame) -> DataFrame:
    """One or two directed rows a segment, quantised; parallel edges stay."""
    ds, m = T.quantise(F.col("length_m"), F.col("kmh"))
    ways = F.when(F.col("two_way"), F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).otherwise(
        F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))
    )
    return segments.select(F.explode(ways).alias("e"), ds.alias("base_ds"), m.alias("length_m"), "grp").select("e.src", "e.dst", "base_ds", "length_m", "grp")


def reverse_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def habitable_nodes(segments: DataFrame) -> DataFrame:
    """(node, is_habitable): touches a segment that is not motorway-like."""
    ends = segments.select(F.explode(F.array("a", "b")).alias("node"), "grp")
    return ends.groupBy("node").agg(F.bool_or(F.col("grp") != config.NO_DELAY_GROUP).alias("is_habitable"))


def junctions(segments: DataFrame) -> DataFrame:
    """(node, neighbours, is_junction): three or more distinct neighbours, whatever the direction."""
    pairs = segments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return both.groupBy("node").agg(F.count("*").alias("neighbours")).withColumn("is_junction", F.col("neighbours") >= 3)


def reindex(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, id, lat, lon): nodes in use numbered 0..N-1 in the order of their ids."""
    used = segments.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return dense_index(used, "id", "node").join(nodes, "id").select("node", "id", "lat", "lon")


class StreetGraph:
    """nodes: node, id, lat, lon, is_junction, is_habitable. edges: src, dst, base_ds, length_m, grp, by node."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, report: DataFrame | None = None):
        self.nodes, self.edges, self.report = nodes, edges, report


def build_street_graph(ways: DataFrame, nodes: DataFrame, max_m: float = config.MAX_SEGMENT_M) -> StreetGraph:
    """All steps from raw ways and nodes to the graph of the largest component, written once."""
    rules = write_shared(describe_ways(ways), "graph-ways")
    cuts = write_shared(cut_segments(way_refs(rules, nodes), max_m), "graph-cuts")
    segments = write_shared(orient_segments(cuts, rules), "graph-segments")
    kept, components = largest_component(segments)
    kept = write_shared(kept, "graph-kept")
    index = write_shared(reindex(kept, nodes), "graph-index")
    flags = junctions(kept).join(habitable_nodes(kept), "node").withColumnRenamed("node", "id")
    out_nodes = write_shared(index.join(flags, "id").select("node", "id", "lat", "lon", "is_junction", "is_habitable"), "graph-nodes")
    number = index.select("id", "node")
    edges = (
        directed_edges(kept).join(number.toDF("src", "s"), "src").join(number.toDF("dst", "d"), "dst")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"), "base_ds", "length_m", "grp")
    )
    return StreetGraph(out_nodes, write_shared(edges, "graph-edges"), components)


def graph_report(graph: StreetGraph, cells: DataFrame, ways: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row of counts that are published with a graph."""
    n = graph.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("is_junction")).alias("junctions"), F.count_if(F.col("is_habitable")).alias("habitable"))
    e = graph.edges.agg(F.count("*").alias("edges"))
    c = cells.agg(F.count_if(F.col("node").isNotNull()).alias("cells"), F.count_if(F.col("node").isNull()).alias("cells_discarded"))
    p = filter_drivable(ways).agg(F.count_if(T.is_private(F.col("tags"))).alias("private_ways"))
    d = cuts.agg(F.count_if(~F.col("kept")).alias("degenerate_segments"))
    return n.crossJoin(e).crossJoin(c).crossJoin(p).crossJoin(d)
