"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from travelfields.shared import drop_shared, scratch, write_shared


def _nearest_neighbour(edges: DataFrame, round_no: int, by_id: bool) -> DataFrame:
    """(node, rep): of each node and its neighbours the one with the least id, or the least hash this round."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    rank = lambda c: F.struct((F.col(c) if by_id else F.xxhash64(F.lit(round_no), c)).alias("h"), F.col(c).alias("v"))
    return (
        both.groupBy("node")
        .agg(F.min(rank("other")).alias("best"))
        .select("node", F.least(F.col("best"), rank("node"))["v"].alias("rep"))
    )


def connected_components(edges: DataFrame, max_rounds: int = 60, rounds_by_id: int = 0) -> DataFrame:
    """Components of an undirected graph.

    edges has long columns a and b; loops, repeats and either direction are allowed, rows
    with a null end are no edge. Returns (node, component) for each end of an edge,
    component being the smallest node id reachable.

    Each round every node joins the neighbour (or itself) that hashes least and the graph
    is contracted, which removes a constant share of its nodes whatever its shape: long
    chains take as few rounds as stars. Only aggregates with map-side combine and joins of
    written tables are used, so the hub of a huge component is split by adaptive skew
    handling. Rounds grow with the logarithm of the nodes. The result is a written table.

    In the first rounds_by_id rounds every node joins the neighbour with the least id instead. Where most nodes hang from smaller
    ones within so many steps, as copies do from the least of their group, that ends what takes ten or more rounds by hash; on
    chains it adds at most these rounds."""
    with scratch():
        return write_shared(_contract(edges, max_rounds, rounds_by_id), "cc-named", keep=True)


def _contract(edges: DataFrame, max_rounds: int, rounds_by_id: int) -> DataFrame:
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    first = write_shared(
        clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"
    )
    live = first.where("a <> b")
    held, maps = first, []
    for round_no in range(max_rounds):
        if live.isEmpty():
            break
        reps = write_shared(_nearest_neighbour(live, round_no, round_no < rounds_by_id), "cc-reps")
        maps.append(reps)
        ra = reps.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        rb = reps.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        contracted = (
            live.join(ra, "a").join(rb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        nxt = write_shared(contracted, "cc-edges")
        if held is not first:
            drop_shared(held)
        held = live = nxt
    else:
        raise RuntimeError("connected_components did not settle")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    root = maps[-1]
    for reps in reversed(maps[:-1]):
        up = root.select(F.col("node").alias("rep"), F.col("rep").alias("top"))
        root = write_shared(
            reps.join(up, "rep", "left").select("node", F.coalesce("top", "rep").alias("rep")), "cc-root"
        )
    # A node that met a round's end as its own representative is named by that round already.
    least = write_shared(root.groupBy("rep").agg(F.min(F.least("node", "rep")).alias("component")), "cc-least")
    named = root.join(least, "rep").select("node", "component")
    alone = first.where("a = b").select(F.col("a").alias("node")).distinct().join(root, "node", "left_anti")
    return named.unionByName(alone.select("node", F.col("node").alias("component")))
