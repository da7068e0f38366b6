"""Weekly cost of candidate cells, its optimum and comparisons. links and fields come from routing.point_fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields import config
from travelfields.shared import scratch, small, write_shared


def default_points(points: DataFrame, slots: DataFrame) -> DataFrame:
    """Missing names, trips and unknown slots get their defaults. slots is a list of a few rows."""
    known = lambda c: F.broadcast(slots.select(F.col("slot").alias(c), F.lit(True).alias(f"{c}_ok")))
    out = points.join(known("slot_out"), "slot_out", "left").join(known("slot_back"), "slot_back", "left")
    name = F.col("name") if "name" in points.columns else F.lit(None).cast("string")
    return out.select(
        *(c for c in points.columns if c not in ("name", "trips", "slot_out", "slot_back")), F.coalesce(name, F.concat(F.lit("Punto "), F.col("point").cast("string"))).alias("name"),
        F.coalesce("trips", F.lit(config.DEFAULT_TRIPS)).alias("trips"), F.when(F.col("slot_out_ok"), F.col("slot_out")).otherwise(config.DEFAULT_SLOT_OUT).alias("slot_out"),
        F.when(F.col("slot_back_ok"), F.col("slot_back")).otherwise(config.DEFAULT_SLOT_BACK).alias("slot_back"),
    )


def active_points(points: DataFrame) -> DataFrame:
    return points.where("trips > 0 and node is not null")


def _legs(links: DataFrame, fields: DataFrame, places: DataFrame) -> DataFrame:
    """One row per link and place (place key columns, node) with out and back costs, null where out of reach.

    Fields are cut to the nodes of places before they meet links, the join that grows with scenarios is on (field, node) pairs
    that exist, and popular fields are split by adaptive skew handling."""
    at = fields.join(places.select("node").distinct(), "node", "left_semi")
    out = at.select(F.col("field").alias("field_out"), "node", F.col("cost").alias("out"))
    back = at.select(F.col("field").alias("field_back"), F.col("node"), F.col("cost").alias("back"))
    return links.join(out, "field_out").join(back, ["field_back", "node"])


def weekly_cost(links: DataFrame, fields: DataFrame, cells: DataFrame) -> DataFrame:
    """(scenario, metric, cell, cost): sum of trips / 2 * (out + t0 + back + t0) over points, in minutes or kilometres. Cells from which any
    active point is out of reach either way have no row. Costs are computed once for each node and then given to its cells."""
    used = links.where("trips > 0")
    legs = _legs(used, fields, cells)
    n = used.groupBy("scenario", "metric").agg(F.count("*").alias("n"))
    term = F.col("trips") / 2 * (F.col("out") + F.col("t0_out") + F.col("back") + F.col("t0_back"))
    by_node = legs.groupBy("scenario", "metric", "node").agg(F.sum(term).alias("total"), F.count("*").alias("reached"), F.first("divisor").alias("divisor"))
    whole = by_node.join(n, ["scenario", "metric"]).where("reached = n").select("scenario", "metric", "node", (F.col("total") / F.col("divisor")).alias("cost"))
    return whole.join(cells.select("cell", "node"), "node").select("scenario", "metric", "cell", "node", "cost")


#: Links that meet one block of nodes in a task.
CHUNK_LINKS = 65_536
_COSTS = "scenario long, metric string, block string, cost array<double>"


def _add_up(fields: pa.Table, links: pa.Table) -> pa.Table:
    """Weekly costs of the nodes of one block for the scenarios of links, from the costs of all their fields there."""
    out = []
    if fields.num_rows and links.num_rows:
        link = links.slice(0, 1).to_pylist()[0]
        ids = fields["field"].to_numpy()
        costs = fields["cost"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        by = np.argsort(ids)
        rows = [link["links"][k] for k in range(len(link["links"]))]
        scenario, trips, divisor, f_out, f_back, t_out, t_back = (np.array(c) for c in zip(*((r["scenario"], r["trips"], r["divisor"], r["field_out"], r["field_back"], r["t0_out"], r["t0_back"]) for r in rows)))
        order = np.argsort(scenario, kind="stable")
        scenarios, first, s = np.unique(scenario[order], return_index=True, return_inverse=True)
        total = np.zeros((len(scenarios), costs.shape[1]))

        def at(field):
            k = np.minimum(np.searchsorted(ids, field, sorter=by), len(ids) - 1)
            return np.where((ids[by[k]] == field)[:, None], costs[by[k]], np.inf)

        for lo in range(0, len(order), 4096):
            o, g = order[lo : lo + 4096], s[lo : lo + 4096]
            term = (trips[o] / 2)[:, None] * (at(f_out[o]) + t_out[o][:, None] + at(f_back[o]) + t_back[o][:, None])
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            total[g[starts]] += np.add.reduceat(term, starts, axis=0)
        total /= divisor[order][first][:, None]
        some = np.isfinite(total).any(1)
        n, width = int(some.sum()), total.shape[1]
        out = [
            pa.array(scenarios[some], pa.int64()), pa.array([link["metric"]] * n, pa.string()), pa.array([fields["block"][0].as_py()] * n, pa.string()),
            pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, total[some].ravel()),
        ]
    kinds = [("scenario", pa.int64()), ("metric", pa.string()), ("block", pa.string()), ("cost", pa.list_(pa.float64()))]
    return pa.Table.from_arrays(out or [pa.array([], k) for _, k in kinds], [n for n, _ in kinds])


def cost_blocks(links: DataFrame, blocks: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """weekly_cost of all nodes as blocks (scenario, metric, block, cost array), infinite where a point is out of reach; still to be written.

    blocks: field, block, cost array; nodes: block, node array. Links are dealt by scenario into chunks of some CHUNK_LINKS, and a block's costs of the
    fields that a chunk uses meet that chunk once. Blocks without a cell are left out."""
    used = links.where("trips > 0")
    sizes = used.groupBy("metric").agg(F.ceil(F.count("*") / CHUNK_LINKS).alias("chunks"))
    chunk = F.pmod(F.xxhash64("scenario"), F.col("chunks")).alias("chunk")
    dealt = write_shared(used.join(F.broadcast(sizes), "metric").select(*links.columns, chunk), "cost-links")
    asked = dealt.select("metric", "chunk", F.explode(F.array("field_out", "field_back")).alias("field")).distinct()
    asked = small(write_shared(asked, "cost-fields"))
    kept = nodes.select("block", F.explode("node").alias("node")).join(cells.select("node"), "node", "left_semi").select("block").distinct()
    kept = write_shared(kept, "cost-nodes")
    link = F.struct("scenario", "trips", "divisor", "field_out", "field_back", "t0_out", "t0_back")
    packed = write_shared(dealt.groupBy("metric", "chunk").agg(F.collect_list(link).alias("links")), "cost-packed")
    packed = packed.crossJoin(F.broadcast(kept)).select(F.col("metric").alias("m"), F.col("chunk").alias("c"), F.col("block").alias("b"), "metric", "links")
    here = blocks.join(F.broadcast(kept), "block").join(asked, "field").select("metric", "chunk", "block", "field", "cost")
    return here.groupBy("metric", "chunk", "block").cogroup(packed.groupBy("m", "c", "b")).applyInArrow(_add_up, _COSTS)


def cells_of_blocks(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(block, cell array, cells array): of each node of a block the lowest cell, null without one, and how many it has; a small table beside the fields."""
    of_node = cells.where("node is not null").groupBy("node").agg(F.min("cell").alias("cell"), F.count("*").alias("cells"))
    at = nodes.select("block", F.posexplode("node").alias("pos", "node")).join(of_node, "node", "left")
    rows = at.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "cell", "cells"))).alias("a"))
    return write_shared(rows.select("block", F.col("a.cell").alias("cell"), F.col("a.cells").alias("cells")), "cost-cells")


def _with_cells(costs: DataFrame, at: DataFrame) -> DataFrame:
    """costs with z: (cost, cell, cells) of each node that has a cell and reaches all points."""
    both = costs.join(F.broadcast(at), "block")
    return both.select("scenario", "metric", F.filter(F.arrays_zip("cost", "cell", "cells"), lambda x: x["cell"].isNotNull() & (x["cost"] < float("inf"))).alias("z"))


def block_optimum(costs: DataFrame, at: DataFrame) -> DataFrame:
    """optimum from cost_blocks and cells_of_blocks: the least (cost, cell) of a block first, then of all blocks."""
    ends = _with_cells(costs, at).where(F.size("z") > 0).select("scenario", "metric", F.array_min("z").alias("low"), F.array_max("z")["cost"].alias("high"))
    first = F.min(F.struct("low.cost", "low.cell"))
    return ends.groupBy("scenario", "metric").agg(first.alias("f"), F.max("high").alias("worst_cost")).select("scenario", "metric", "f.cell", F.col("f.cost").alias("best_cost"), "worst_cost")


def _pick(share: float, name: str):
    def run(costs: pa.Table) -> pa.Table:
        c, n = (costs[k].combine_chunks().flatten().to_numpy() for k in ("cost", "cells"))
        order = np.argsort(c, kind="stable")
        upto = np.cumsum(n[order])
        at = min(int(np.floor(upto[-1] * share)), int(upto[-1]) - 1)
        value = c[order][np.searchsorted(upto, at, side="right")]
        return pa.table({"scenario": costs["scenario"].slice(0, 1), "metric": costs["metric"].slice(0, 1), name: pa.array([value], pa.float64())})

    return run


def block_rank_pick(costs: DataFrame, at: DataFrame, nodes: DataFrame, cells: DataFrame, share: float, name: str) -> DataFrame:
    """rank_pick of the costs of all cells. On a network of up to WINDOW_ROWS nodes a task orders those of one scenario and metric, as doubles with their number of cells;
    on a larger one the rows go to rank_pick."""
    keys = ["scenario", "metric"]
    if nodes.select(F.sum(F.size("node"))).first()[0] > WINDOW_ROWS:
        return rank_pick(cost_rows(costs, nodes, cells), keys, "cost", share, name)
    z = _with_cells(costs, at).where(F.size("z") > 0).select(*keys, F.col("z.cost").alias("cost"), F.col("z.cells").alias("cells"))
    return z.groupBy(*keys).applyInArrow(_pick(share, name), f"scenario long, metric string, {name} double")


def cost_rows(costs: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """weekly_cost's rows (scenario, metric, cell, node, cost) from cost_blocks."""
    both = costs.join(small(nodes), "block").select("scenario", "metric", F.inline(F.arrays_zip("node", "cost"))).where(F.col("cost") < float("inf"))
    return both.join(small(cells.select("cell", "node")), "node").select("scenario", "metric", "cell", "node", "cost")


def optimum(cost: DataFrame) -> DataFrame:
    """(scenario, metric, cell, best_cost, worst_cost); ties go to the lowest cell. Costs are sums of multiples of config.COST_UNIT, so
    equal ones are equal in whatever order they were summed."""
    first = F.min(F.struct("cost", "cell"))["cell"]
    return cost.groupBy("scenario", "metric").agg(first.alias("cell"), F.min("cost").alias("best_cost"), F.max("cost").alias("worst_cost"))


#: Distinct values of a group that one window orders; more are narrowed down by counts of ranges first, of which each pass makes so many.
WINDOW_ROWS, RANGES = 65_536, 1024


def rank_pick(values: DataFrame, keys: list[str], value: str, share: float, name: str, window_rows: int = WINDOW_ROWS, ranges: int = RANGES) -> DataFrame:
    """The value at position floor(share * n) of the sorted values of each group, from 0; not interpolated. Nulls don't count.

    Equal values are counted first. As long as a group's candidates are more than window_rows, they are counted by ranges of equal width between
    their ends, and only the range that holds the position goes on, so that no window has to order a group of any size."""
    with scratch():
        counted = write_shared(values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "rank-values")
        todo = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        at = F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
        todo = write_shared(todo.select(*keys, at.alias("_at"), F.lit(0).cast("long").alias("_before"), "_rows", "_lo", "_hi"), "rank-groups")
        done = None
        wide = (F.col("_rows") > window_rows) & (F.col("_lo") < F.col("_hi"))
        while True:
            ready = todo.where(~wide)
            done = ready if done is None else done.unionByName(ready)
            todo = todo.where(wide)
            if todo.isEmpty():
                break
            inside = counted.join(todo, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            cut = F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges))
            group = [*keys, "_at", "_before"]
            parts = inside.groupBy(*group, cut.alias("_cut")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            line = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, 0)
            upto = parts.withColumn("_upto", F.col("_before") + F.sum("_n").over(line))
            mine = upto.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
            todo = write_shared(mine.select(*keys, "_at", (F.col("_upto") - F.col("_n")).alias("_before"), "_rows", "_lo", "_hi"), "rank-groups")
        near = counted.join(done, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        line = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        ranked = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(line))
        return write_shared(ranked.where(F.col("_upto") > F.col("_at")).groupBy(*keys).agg(F.min("_v").alias(name)), "rank-picks", keep=True)


def summary(cost: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """Per scenario and metric: optimum, its zone, trips, cost per trip and what it saves against the median cell."""
    return summed_up(optimum(cost), rank_pick(cost, ["scenario", "metric"], "cost", 0.5, "median_cost"), points, cells)


def summed_up(best: DataFrame, median: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """summary from the optimum and the median cost."""
    best = best.join(cells.select("cell", "zone_id"), "cell")
    trips = active_points(points).groupBy("scenario").agg(F.sum("trips").alias("trips"))
    out = best.join(median, ["scenario", "metric"]).join(trips, "scenario")
    return out.select(
        "scenario", "metric", "cell", "zone_id", "trips", "best_cost", (F.col("best_cost") / F.greatest(F.lit(1), F.col("trips"))).alias("cost_per_trip"), (F.col("median_cost") - F.col("best_cost")).alias("saving")
    )


def breakdown(places: DataFrame, links: DataFrame, fields: DataFrame) -> DataFrame:
    """places: place, scenario, node. Per point: out, back and weekly, and the total of the place over its finite rows. Points out of
    reach stay with nulls."""
    base = places.join(links, "scenario")
    out = fields.select(F.col("field").alias("field_out"), "node", F.col("cost").alias("c_out"))
    back = fields.select(F.col("field").alias("field_back"), "node", F.col("cost").alias("c_back"))
    legs = base.join(out, ["field_out", "node"], "left").join(back, ["field_back", "node"], "left")
    legs = legs.withColumn("out", (F.col("c_out") + F.col("t0_out")) / F.col("divisor")).withColumn("back", (F.col("c_back") + F.col("t0_back")) / F.col("divisor"))
    legs = legs.withColumn("weekly", F.col("trips") / 2 * (F.col("out") + F.col("back")))
    total = F.coalesce(F.sum("weekly").over(W.partitionBy("scenario", "metric", "place")), F.lit(0.0))
    return legs.withColumn("total", total).select("scenario", "metric", "place", "point", "trips", "out", "back", "weekly", "total")


def compare_places(places: DataFrame, links: DataFrame, fields: DataFrame, best: DataFrame, close: float = 0.5) -> DataFrame:
    """Weekly total of snapped places, its difference to the optimum, and whether that is small."""
    total = breakdown(places, links, fields).groupBy("scenario", "metric", "place").agg(F.first("total").alias("total"))
    return total.join(best.select("scenario", "metric", "best_cost"), ["scenario", "metric"]).withColumn("difference", F.col("total") - F.col("best_cost")).withColumn("is_good", F.col("difference") <= close)


def traffic_share(cost: DataFrame) -> DataFrame:
    """Per scenario and cell: weekly time, the same at dawn, and the difference, which is traffic."""
    time, dawn = (cost.where(F.col("metric") == m).select("scenario", "cell", F.col("cost").alias(c)) for m, c in (("tiempo", "time_cost"), ("flujo_libre", "dawn_cost")))
    return time.join(dawn, ["scenario", "cell"]).withColumn("traffic", F.col("time_cost") - F.col("dawn_cost"))


def reweight(links: DataFrame, new_trips: DataFrame) -> DataFrame:
    """links with other trips (scenario, point, trips); stored fields serve them without new searches."""
    return links.drop("trips").join(new_trips.select("scenario", "point", "trips"), ["scenario", "point"])


def points_bbox(points: DataFrame) -> DataFrame:
    return points.groupBy("scenario").agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def cost_by_zone(cost: DataFrame, cells: DataFrame) -> DataFrame:
    return cost.join(cells.select("cell", "zone_id"), "cell").groupBy("scenario", "metric", "zone_id").agg(F.count("*").alias("cells"), F.min("cost").alias("best_cost"), F.avg("cost").alias("mean_cost"))


def solve(points: DataFrame, cells: DataFrame, links: DataFrame, fields: DataFrame) -> DataFrame:
    """Summary of all scenarios, from stored fields."""
    return summary(write_shared(weekly_cost(links, fields, cells), "weekly-cost"), points, cells)


