"""Zones, lattices and nearest streets.

Rings come as ring_edges(zone_id, ring_id, k, lat_a, lon_a, lat_b, lon_b); boxes as (zone_id, lat_min, lat_max, lon_min, lon_max)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields import config
from travelfields.shared import scratch, small, write_shared

#: Rings and points up to this many rows go to every task; larger sides are joined by a bucket.
BROADCAST_ROWS = 200_000
#: Nodes of a bucket in which nearest_any looks at most; nodes of a pyramid's leaf, levels below its root, and degrees of the root.
BUCKET_NODES, LEAF_NODES, LEVELS, ROOT_DEG = 2048, 64, 11, 512.0


def _stitch(pieces: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Join pieces at equal end points, in either direction, until each line closes or nothing fits."""
    open_ends: dict[tuple, set[int]] = {}
    for k, p in enumerate(pieces):
        for end in (p[0], p[-1]):
            open_ends.setdefault(end, set()).add(k)
    left, rings = set(range(len(pieces))), []

    def take(point):
        near = open_ends.get(point, set()) & left
        if not near:
            return None
        k = min(near)
        left.discard(k)
        return pieces[k] if pieces[k][0] == point else pieces[k][::-1]

    while left:
        line = list(pieces[k := max(left)])
        left.discard(k)
        while line[0] != line[-1]:
            if nxt := take(line[-1]):
                line += nxt[1:]
            elif nxt := take(line[0]):
                line = nxt[:0:-1] + line
            else:
                break
        if len(line) >= 4:
            rings.append(line if line[0] == line[-1] else [*line, line[0]])
    return rings


def _stitch_rows(batches):
    for batch in batches:
        rows = []
        for relation, pieces in zip(batch.column("relation_id").to_pylist(), batch.column("pieces").to_pylist()):
            lines = [[(v["lat"], v["lon"]) for v in p] for p in pieces or [] if p and len(p) >= 2]
            rows += [(relation, r, k, lat, lon) for r, ring in enumerate(_stitch(lines)) for k, (lat, lon) in enumerate(ring)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["relation_id", "ring_id", "k", "lat", "lon"])


def assemble_rings(relations: DataFrame) -> DataFrame:
    """relations: id, members(type, role, geometry(lat, lon)). Returns (relation_id, ring_id, k, lat, lon), closed rings of
    the outer pieces; roles but outer and none are left out, so holes are ignored. Each row is stitched where it is, without a shuffle."""
    outer = F.filter("members", lambda m: (m["type"] == "way") & F.coalesce(m["role"], F.lit("")).isin("outer", ""))
    pieces = F.transform(outer, lambda m: F.filter(m["geometry"], lambda p: p["lat"].isNotNull()))
    rows = relations.select(F.col("id").cast("long").alias("relation_id"), pieces.alias("pieces"))
    return rows.mapInArrow(_stitch_rows, "relation_id long, ring_id int, k int, lat double, lon double")


def ring_edges(rings: DataFrame) -> DataFrame:
    """rings: zone_id, ring_id, k, lat, lon. Consecutive vertex pairs."""
    line = W.partitionBy("zone_id", "ring_id").orderBy("k")
    nxt = rings.select("zone_id", "ring_id", "k", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.lead("lat").over(line).alias("lat_b"), F.lead("lon").over(line).alias("lon_b"))
    return nxt.where("lat_b is not null")


def _odd_crossings(points: DataFrame, edges: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Distinct (keys, zone_id, ring_id) of points (keys, lat, lon, and zone_id and ring_id where only those rings are asked for) that an upward ray leaves through an odd number of edges. Points
    and edges are keyed by longitude bucket, as only an edge that spans a point's longitude can be crossed."""
    lo, hi = F.least("lon_a", "lon_b"), F.greatest("lon_a", "lon_b")
    keyed = edges.where("lon_a <> lon_b").withColumn("bucket", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    on = ["bucket", *(c for c in ("zone_id", "ring_id") if c in points.columns)]
    hits = points.withColumn("bucket", F.floor(F.col("lon") / bucket).cast("long")).join(keyed, on).where((F.col("lon_a") > F.col("lon")) != (F.col("lon_b") > F.col("lon")))
    cut = (F.col("lat_b") - F.col("lat_a")) * (F.col("lon") - F.col("lon_a")) / (F.col("lon_b") - F.col("lon_a")) + F.col("lat_a")
    return hits.groupBy(*keys, "zone_id", "ring_id").agg(F.count_if(F.col("lat") < cut).alias("n")).where("n % 2 = 1").drop("n")


def border_cells(edges: DataFrame, bucket: float) -> DataFrame:
    """(zone_id, ring_id, cx, cy): cells of bucket degrees through which, or within 1e-9 degrees of which, an edge of the ring passes."""
    margin = 1e-9
    lo, hi = F.least("lon_a", "lon_b"), F.greatest("lon_a", "lon_b")
    low, high = F.least("lat_a", "lat_b"), F.greatest("lat_a", "lat_b")
    cut = edges.withColumn("cx", F.explode(F.sequence(F.floor((lo - margin) / bucket), F.floor((hi + margin) / bucket))))
    height = lambda x: F.when(F.col("lon_a") == F.col("lon_b"), None).otherwise(F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * (x - F.col("lon_a")) / (F.col("lon_b") - F.col("lon_a")))
    west, east = height(F.greatest(lo, F.col("cx") * bucket - margin)), height(F.least(hi, (F.col("cx") + 1) * bucket + margin))
    south, north = F.greatest(low, F.coalesce(F.least(west, east), low)), F.least(high, F.coalesce(F.greatest(west, east), high))
    rows = F.sequence(F.floor((F.least(south, north) - margin) / bucket), F.floor((F.greatest(south, north) + margin) / bucket))
    return cut.select("zone_id", "ring_id", "cx", F.explode(rows).alias("cy")).distinct()


def points_in_rings(points: DataFrame, edges: DataFrame, bucket: float = 0.002) -> DataFrame:
    """(point, zone_id) of points (point, lat, lon) inside a ring, by even-odd crossings.

    Rings are covered by cells. A cell through which no edge of a ring passes lies inside or outside as a whole: its centre is tested for it, once,
    and its points are answered by an equi-join on the cell. Only points in cells on a ring's border meet that ring's edges, those of their longitude bucket."""
    with scratch():
        key = lambda c: F.floor(F.col(c) / bucket).cast("long")
        placed = points.select("point", "lat", "lon", key("lon").alias("cx"), key("lat").alias("cy"))
        border = write_shared(border_cells(edges, bucket), "rings-border")
        centres = placed.select("cx", "cy").distinct().select("cx", "cy", ((F.col("cy") + 0.5) * bucket).alias("lat"), ((F.col("cx") + 0.5) * bucket).alias("lon"))
        whole = _odd_crossings(centres, edges, ["cx", "cy"], bucket).join(border, ["zone_id", "ring_id", "cx", "cy"], "left_anti").select("cx", "cy", "zone_id").distinct()
        inside = placed.select("point", "cx", "cy").join(whole, ["cx", "cy"]).select("point", "zone_id")
        near = _odd_crossings(placed.join(border, ["cx", "cy"]).drop("cx", "cy"), edges, ["point"], bucket).select("point", "zone_id")
        return write_shared(inside.unionByName(near).distinct(), "rings-points", keep=True)


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(point, zone_id) inside a manual box, inclusive. Boxes are typed in by hand: a broadcast range join, for at most BROADCAST_ROWS."""
    if boxes.count() > BROADCAST_ROWS:
        raise ValueError("too many boxes for a broadcast; give them as rings")
    inside = (F.col("lat") >= F.col("lat_min")) & (F.col("lat") <= F.col("lat_max")) & (F.col("lon") >= F.col("lon_min")) & (F.col("lon") <= F.col("lon_max"))
    return points.join(F.broadcast(boxes), inside).select("point", "zone_id").distinct()


def in_mask(points: DataFrame, edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in any ring or box."""
    hits = points_in_rings(points, edges).union(in_boxes(points, boxes)).select("point").distinct()
    return points.join(hits, "point", "left_semi")


def mask_bbox(edges: DataFrame, boxes: DataFrame, clip: dict | None = None) -> DataFrame:
    """One row lat_min, lat_max, lon_min, lon_max of rings and boxes, clipped; an empty mask is an error."""
    spans = edges.select("lat_a", "lat_a", "lon_a", "lon_a").toDF("a", "b", "c", "d").union(boxes.select("lat_min", "lat_max", "lon_min", "lon_max"))
    box = spans.agg(F.min("a").alias("lat_min"), F.max("b").alias("lat_max"), F.min("c").alias("lon_min"), F.max("d").alias("lon_max"))
    if clip:
        box = box.select(
            F.greatest("lat_min", F.lit(clip["lat_min"])).alias("lat_min"), F.least("lat_max", F.lit(clip["lat_max"])).alias("lat_max"),
            F.greatest("lon_min", F.lit(clip["lon_min"])).alias("lon_min"), F.least("lon_max", F.lit(clip["lon_max"])).alias("lon_max"),
        )
    return box.withColumn("lat_min", F.coalesce("lat_min", F.raise_error(F.lit("the mask is empty")).cast("double")))


def grid_meta(bbox: DataFrame, spacing_m: float = config.GRID_SPACING_M) -> DataFrame:
    """One row: steps and counts of the lattice over a one-row bbox."""
    mid = F.radians((F.col("lat_min") + F.col("lat_max")) / 2)
    out = bbox.withColumn("step_lat", F.lit(spacing_m / config.M_PER_DEG)).withColumn("step_lon", spacing_m / (config.M_PER_DEG * F.cos(mid)))
    n = lambda lo, hi, step: (F.floor((F.col(hi) - F.col(lo)) / F.col(step)) + 1).cast("long")
    return out.withColumn("nx", n("lon_min", "lon_max", "step_lon")).withColumn("ny", n("lat_min", "lat_max", "step_lat"))


def lattice(spark: SparkSession, bbox: DataFrame, spacing_m: float = config.GRID_SPACING_M) -> DataFrame:
    """(point, ix, iy, lat, lon): every lattice point, numbered row by row from the south-west."""
    m = grid_meta(bbox, spacing_m).first()
    ids = spark.range(m["nx"] * m["ny"]).select(F.col("id").alias("point"), (F.col("id") % m["nx"]).cast("int").alias("ix"), F.floor(F.col("id") / m["nx"]).cast("int").alias("iy"))
    return ids.select("point", "ix", "iy", (F.lit(m["lat_min"]) + F.col("iy") * m["step_lat"]).alias("lat"), (F.lit(m["lon_min"]) + F.col("ix") * m["step_lon"]).alias("lon"))


def nearest_within(points: DataFrame, nodes: DataFrame, radius_m: float = config.SNAP_RADIUS_M, bucket_m: float = config.SNAP_BUCKET_M) -> DataFrame:
    """points (point, lat, lon, ...) with node and distance_m of the nearest of nodes (node, lat, lon), null beyond radius_m.

    Nodes are keyed by square buckets, points look into 3 x 3 of them by an equi-join, and the minimum is combined before the
    shuffle. Ties go to the first by bucket row, bucket column and node. One longitude scale, of the mean latitude of all
    nodes, is used. Where a bucket holds more than BUCKET_NODES nodes, points go down a pyramid of cells instead, which gives the same."""
    if radius_m >= bucket_m:
        raise ValueError("the radius must be smaller than a bucket")
    mean = nodes.agg(F.avg("lat")).first()[0] or 0.0
    scale = config.M_PER_DEG * math.cos(math.radians(mean))
    row = lambda c: F.floor(F.col(c) * config.M_PER_DEG / bucket_m).cast("long")
    col = lambda c: F.floor(F.col(c) * scale / bucket_m).cast("long")
    grid = nodes.select(F.col("node"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).withColumn("row", row("n_lat")).withColumn("col", col("n_lon"))
    if (grid.groupBy("row", "col").count().agg(F.max("count")).first()[0] or 0) > BUCKET_NODES:
        with scratch():
            far = _nearest_down_pyramid(points, nodes, F.lit(scale), F.lit(config.M_PER_DEG), radius_m * radius_m, [row("n_lat").alias("row"), col("n_lon").alias("col")])
            return write_shared(far.withColumn("distance_m", F.sqrt("d2")).drop("d2"), "nearest-within", keep=True)
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    asked = points.select("point", "lat", "lon", offsets.alias("o")).select("point", "lat", "lon", (row("lat") + F.col("o.a")).alias("row"), (col("lon") + F.col("o.b")).alias("col"))
    dy, dx = (F.col("n_lat") - F.col("lat")) * config.M_PER_DEG, (F.col("n_lon") - F.col("lon")) * scale
    d2 = dx * dx + dy * dy
    best = asked.join(grid, ["row", "col"]).withColumn("d2", d2).where(F.col("d2") <= radius_m * radius_m).groupBy("point").agg(F.min(F.struct("d2", "row", "col", "node")).alias("best"))
    return points.join(best, "point", "left").select(*points.columns, F.col("best.node").alias("node"), F.sqrt("best.d2").alias("distance_m"))


def nearest_any(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points with the nearest node whatever its distance; longitude is scaled at the point, ties go to the lowest node.

    Points look in the buckets around them first, which are so small that none holds more than BUCKET_NODES nodes. Those that find nothing there go down a pyramid
    of cells. Without nodes, node is null."""
    radius = 500.0
    while radius > 1.0 and (nodes.groupBy(*(F.floor(F.col(c) * config.M_PER_DEG / radius) for c in ("lat", "lon"))).count().agg(F.max("count")).first()[0] or 0) > BUCKET_NODES:
        radius /= 2
    with scratch():
        found = write_shared(_nearest_in_buckets(points, nodes, radius), "nearest", keep=True)
        left = found.where("node is null").drop("node")
        if left.isEmpty():
            return found
        return found.where("node is not null").unionByName(_nearest_down_pyramid(left, nodes, F.cos(F.radians("lat")), F.lit(1.0)).drop("d2"))


def _cell_pyramid(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, nodes at their leaf). Cells of a level are split sixteenfold as long as they hold more than LEAF_NODES nodes: (level, row, col, n, up_row, up_col, is_leaf and the box
    of its nodes)."""
    step = lambda level: F.lit(ROOT_DEG) / F.pow(F.lit(4.0), level)
    level = F.col("level")
    spread = nodes.select("node", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    spread = spread.withColumn("row", F.floor((F.col("n_lat") + 90) / step(level))).withColumn("col", F.floor((F.col("n_lon") + 180) / step(level)))
    box = [f(f"n_{c}").alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    cells = write_shared(spread.groupBy("level", "row", "col").agg(F.count("*").alias("n"), *box), "pyramid-all")
    cells = cells.withColumn("up_row", F.floor(F.col("row") / 4)).withColumn("up_col", F.floor(F.col("col") / 4)).withColumn("is_leaf", (F.col("n") <= LEAF_NODES) | (level == LEVELS))
    split = cells.where("not is_leaf").select((level + 1).alias("level"), F.col("row").alias("up_row"), F.col("col").alias("up_col"))
    cells = write_shared(cells.where("level = 0").unionByName(cells.join(split, ["level", "up_row", "up_col"], "left_semi").select(*cells.columns)), "pyramid")
    leaves = cells.where("is_leaf").select("level", "row", "col")
    return cells, write_shared(spread.join(leaves, ["level", "row", "col"], "left_semi"), "pyramid-leaves")


def _nearest_down_pyramid(points: DataFrame, nodes: DataFrame, lon_scale: Column, lat_scale: Column, reach: float = math.inf, ties: list[Column] | None = None) -> DataFrame:
    """points with node and d2 of the nearest node, level by level: of a point's cells those go on whose nearest corner is no farther than the farthest corner of its best cell.
    Differences of degrees are scaled by lon_scale and lat_scale; nodes with d2 over `reach` don't count; equal d2 go by ties (of n_lat, n_lon) and then by node."""
    cells, leaves = _cell_pyramid(nodes)
    far = lambda c: F.greatest(F.abs(F.col(f"{c}_min") - F.col(c)), F.abs(F.col(f"{c}_max") - F.col(c)))
    near = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}_min") - F.col(c), F.col(c) - F.col(f"{c}_max"))
    square = lambda dx, dy: (dx * lon_scale) * (dx * lon_scale) + (dy * lat_scale) * (dy * lat_scale)
    columns = ["point", "lat", "lon", "level", "row", "col", "is_leaf", "least", "most"]
    bounded = lambda df: df.withColumn("least", square(near("lon"), near("lat"))).withColumn("most", square(far("lon"), far("lat"))).where(F.col("least") <= reach).select(*columns)
    live = bounded(points.select("point", "lat", "lon").join(F.broadcast(cells.where("level = 0")), how="cross"))  # one cell at most
    for _ in range(LEVELS):
        down = cells.select("level", "row", "col", "is_leaf", F.col("up_row"), F.col("up_col"), "lat_min", "lat_max", "lon_min", "lon_max")
        inner = live.where("not is_leaf").select("point", "lat", "lon", (F.col("level") + 1).alias("level"), F.col("row").alias("up_row"), F.col("col").alias("up_col"))
        met = live.where("is_leaf").unionByName(bounded(inner.join(down, ["level", "up_row", "up_col"])))
        best = met.groupBy("point").agg(F.min("most").alias("best"))
        live = write_shared(met.join(best, "point").where("least <= best").select(*columns), "pyramid-live")
        if live.where("not is_leaf").isEmpty():
            break
    d2 = square(F.col("n_lon") - F.col("lon"), F.col("n_lat") - F.col("lat")).alias("d2")
    best = live.join(leaves, ["level", "row", "col"]).select("point", d2, F.struct(d2, *(ties or []), "node").alias("order")).where(F.col("d2") <= reach)
    best = best.groupBy("point").agg(F.min("order").alias("best"))
    return write_shared(points.join(best, "point", "left").select(*points.columns, F.col("best.node").alias("node"), F.col("best.d2").alias("d2")), "nearest-far", keep=True)


def _nearest_in_buckets(points: DataFrame, nodes: DataFrame, radius_m: float) -> DataFrame:
    step = radius_m / config.M_PER_DEG
    key = lambda c: F.floor(F.col(c) / step).cast("long")
    grid = nodes.select("node", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).withColumn("row", key("n_lat")).withColumn("col", key("n_lon"))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    asked = points.select("point", "lat", "lon", around.alias("o")).select("point", "lat", "lon", (key("lat") + F.col("o.a")).alias("row"), (key("lon") + F.col("o.b")).alias("col"))
    c = F.cos(F.radians("lat"))
    dy, dx = F.col("n_lat") - F.col("lat"), (F.col("n_lon") - F.col("lon")) * c
    # Whatever lies outside the nine buckets is at least step * cos(lat) away.
    sure = F.col("d2") <= F.pow(F.lit(step) * c, 2)
    best = asked.join(grid, ["row", "col"]).withColumn("d2", dx * dx + dy * dy).where(sure).groupBy("point").agg(F.min(F.struct("d2", "node")).alias("best"))
    return points.join(best, "point", "left").select(*points.columns, F.col("best.node").alias("node"))


def select_zones(zones: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zones with a wanted name, wanted names that are missing)."""
    return zones.join(small(wanted), "name", "left_semi"), wanted.join(zones.select("name"), "name", "left_anti")


def zone_of_points(points: DataFrame, edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """points with zone_id, the first zone in mask order that holds them, 0 outside all. zone_id is the order, from 1."""
    hits = points_in_rings(points, edges).union(in_boxes(points, boxes)).groupBy("point").agg(F.min("zone_id").alias("zone_id"))
    return points.join(hits, "point", "left").withColumn("zone_id", F.coalesce("zone_id", F.lit(0)))


def candidate_cells(spark: SparkSession, nodes: DataFrame, edges: DataFrame, boxes: DataFrame, clip: dict | None = None, spacing_m: float = config.GRID_SPACING_M) -> DataFrame:
    """Lattice points in the mask, snapped to habitable nodes, with zone_id. node is null for cells to discard."""
    box = mask_bbox(edges, boxes, clip)
    inside = write_shared(in_mask(lattice(spark, box, spacing_m), edges, boxes), "cells-mask")
    snapped = nearest_within(inside, nodes.where("is_habitable"))
    return zone_of_points(snapped, edges, boxes).withColumnRenamed("point", "cell")
