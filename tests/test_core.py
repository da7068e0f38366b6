"""Rules, graph, routes, costs and fits against plain Python."""

import heapq
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from travelfields import config, queries
from travelfields.functions import tags as T
from travelfields.functions.display import format_cost
from travelfields.operators import calibration as K
from travelfields.operators import routing as R
from travelfields.operators import spatial as D
from travelfields.operators import streets as G
from travelfields.operators.components import connected_components
from travelfields.operators.cost import rank_pick
from travelfields.sources import extract, tables

SF = "/root/testdata/sf0.001"


def test_tag_rules(spark):
    rows = [
        ({"highway": "motorway"}, False, 1, None), ({"oneway": "no", "junction": "roundabout"}, False, 0, None), ({"junction": "Circular"}, False, 1, None),
        ({"oneway": " -1 "}, False, -1, None), ({"access": "private", "motor_vehicle": "yes"}, False, 0, None), ({"access": " Private"}, True, 0, None),
        ({"vehicle": "no"}, True, 0, None), ({"maxspeed": "50 km/h"}, False, 0, 50.0), ({"maxspeed": "60,5"}, False, 0, 60.5), ({"maxspeed": "signals"}, False, 0, None),
        ({"maxspeed": "4"}, False, 0, None), ({"maxspeed": "131"}, False, 0, None), ({"maxspeed": ""}, False, 0, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, tags map<string,string>")
    got = df.select("k", T.is_private(F.col("tags")), T.oneway(F.col("tags"), F.coalesce(F.col("tags")["highway"], F.lit("x"))), T.maxspeed(F.col("tags"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_cut_resets_and_keeps_loops(spark):
    step = 100 / config.M_PER_DEG
    nodes = spark.createDataFrame([(k, k * step, 0.0) for k in range(12)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, list(range(10))), (2, [5, 10, 11, 5])], "id long, nodes array<long>")
    cuts = G.cut_segments(G.way_refs(ways, nodes)).collect()
    got = sorted((r.way, r.a, r.b, r.kept) for r in cuts)
    assert got == [(1, 0, 4, True), (1, 4, 5, True), (1, 5, 9, True), (2, 5, 10, True), (2, 10, 5, True)]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    for by_id in (0, 3):
        got = {r.node: r.component for r in connected_components(table, rounds_by_id=by_id).collect()}
        assert got == {x: find(x) for x in parent}


def test_stars_of_stars_end_in_as_many_rounds_as_they_are_deep(spark):
    # 4,000 nodes hang from each hundredth, these from each thousandth.
    edges = [(k, k // 1000 * 1000 if k % 100 == 0 else k // 100 * 100) for k in range(4000)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(table, max_rounds=3, rounds_by_id=3).collect()}
    assert got == {k: k // 1000 * 1000 for k in range(4000)}


def _lattice(spark, n=7):
    nodes = [(k, k // n * 0.004, k % n * 0.004, (k * 7) % 3 == 0) for k in range(n * n)]
    edges = []
    for k in range(n * n):
        for d, ok in ((1, k % n < n - 1), (n, k < n * n - n)):
            if ok:
                edges += [(k, k + d, 10 + (k * 31 + d) % 57, 100, (k + d) % 3), (k + d, k, 10 + (k * 17 + d) % 43, 100, (k + d) % 3)]
    return spark.createDataFrame(nodes, "node long, lat double, lon double, is_junction boolean"), spark.createDataFrame(edges, "src long, dst long, base_ds int, length_m int, grp int")


def _dijkstra(adj, s):
    dist, heap = {}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, w in adj.get(u, ()):
            if v not in dist:
                heapq.heappush(heap, (d + w, v))
    return dist


def test_fields_blocked_plain_and_dijkstra_agree(spark):
    nodes, edges = _lattice(spark)
    slots = K.prior_params(spark).where("slot = 'punta_am'")
    w = R.edge_weights(edges, nodes, slots, R.metric_catalogue(spark).where("metric = 'tiempo'")).withColumn("weight_id", F.lit("x")).select("weight_id", "src", "dst", "w")
    src = spark.createDataFrame([(0, "x", 0), (1, "x", 24), (2, "x", 48)], "field long, weight_id string, node long")
    blocked = {(r.field, r.node): r.cost for r in R.cost_field(w, src, nodes, 0.009).collect()}
    plain = {(r.field, r.node): r.cost for r in R.cost_field_plain(w, src).collect()}
    assert blocked == plain
    adj = {}
    for r in w.collect():
        adj.setdefault(r.src, []).append((r.dst, r.w))
    for f, s in ((0, 0), (1, 24), (2, 48)):
        for v, d in _dijkstra(adj, s).items():
            assert math.isclose(blocked[f, v], d)


def test_od_routes_decompose_the_best_time(spark):
    nodes, edges = _lattice(spark)
    slots = K.prior_params(spark).where("slot = 'valle'").select("slot", "g", "d_s")
    pairs = spark.createDataFrame([("a", 0, 48), ("b", 3, 3 + 21), ("c", 0, 6)], "pair string, origin long, target long")
    s = slots.first()
    junction = {r.node: r.is_junction for r in nodes.collect()}
    adj = {}
    for r in edges.collect():
        adj.setdefault(r.src, []).append((r.dst, r.base_ds / 10 * s.g[r.grp] + (s.d_s if junction[r.dst] and r.grp else 0)))
    for r in R.od_routes(pairs, edges, nodes, slots, 0.009).collect():
        origin, target = {"a": (0, 48), "b": (3, 24), "c": (0, 6)}[r.pair]
        assert math.isclose(r.time_s, _dijkstra(adj, origin)[target])
        rest = r.time_s - (r.ff0 * s.g[0] + r.ff1 * s.g[1] + r.ff2 * s.g[2] + r.crossings * s.d_s)
        assert min(abs(rest), abs(rest - s.d_s)) < 1e-6  # the end's own junction is not counted


def test_nearest_within_is_brute_force(spark):
    rng = np.random.default_rng(3)
    nodes = [(k, -33.4 + a, -70.6 + b) for k, (a, b) in enumerate((rng.random((60, 2)) * 0.02).tolist())]
    points = [(k, -33.4 + a, -70.6 + b) for k, (a, b) in enumerate((rng.random((40, 2)) * 0.03).tolist())]
    scale = config.M_PER_DEG * math.cos(math.radians(sum(n[1] for n in nodes) / len(nodes)))
    schema = "{} long, lat double, lon double"
    got = D.nearest_within(spark.createDataFrame(points, schema.format("point")), spark.createDataFrame(nodes, schema.format("node"))).collect()
    anywhere = {r.point: r.node for r in D.nearest_any(spark.createDataFrame(points, schema.format("point")), spark.createDataFrame(nodes, schema.format("node"))).collect()}
    for r in got:
        d, n = min((((r.lat - y) * config.M_PER_DEG) ** 2 + ((r.lon - x) * scale) ** 2, k) for k, y, x in nodes)
        assert r.node == (n if d <= 300**2 else None)
        c = math.cos(math.radians(r.lat))
        assert anywhere[r.point] == min(((y - r.lat) ** 2 + ((x - r.lon) * c) ** 2, k) for k, y, x in nodes)[1]


def test_rings_are_stitched_from_shuffled_pieces(spark):
    a, b, c, d = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)
    geo = lambda ps: [{"lat": y, "lon": x} for y, x in ps]
    members = [("way", "outer", geo([c, b])), ("way", "", geo([a, b])), ("way", "outer", geo([a, d, c])), ("way", "inner", geo([a, c])), ("node", "outer", None)]
    kind = "id long, members array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>"
    rings = D.assemble_rings(spark.createDataFrame([(1, members)], kind)).orderBy("k").collect()
    ring = [(r.lat, r.lon) for r in rings]
    assert ring[0] == ring[-1] and set(ring) == {a, b, c, d} and len(ring) == 5


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_box_fit_beats_random_points(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 5)) * [1, 300, 200, 100, 4]
    y = rng.normal(size=12) * 500
    lo, hi = np.array(config.BOUNDS).T
    m, b = a.T @ a + np.eye(5), a.T @ y
    x = K.solve_box(m, b, lo, hi)
    value = lambda v: v @ m @ v - 2 * b @ v
    assert (x >= lo - 1e-9).all() and (x <= hi + 1e-9).all()
    assert all(value(x) <= value(lo + rng.random(5) * (hi - lo)) + 1e-6 for _ in range(50))


def test_rank_pick_and_formats(spark):
    df = spark.createDataFrame([(1, v) for v in (5.0, 1.0, 1.0, 9.0)] + [(2, 3.0)], "g int, v double")
    assert {r.g: r.m for r in rank_pick(df, ["g"], "v", 0.5, "m").collect()} == {1: 5.0, 2: 3.0}
    shown = spark.createDataFrame([(45.0, "min"), (125.0, "min"), (120.0, "min"), (9.34, "km"), (12.5, "km"), (None, "km")], "v double, u string")
    assert [r[0] for r in shown.select(format_cost(F.col("v"), F.col("u"))).collect()] == ["45 min", "2 h 5 min", "2 h", "9.3 km", "13 km", "—"]


def test_point_list(spark):
    lines = spark.createDataFrame([(0, " casa; Calle 1; 3.5 "), (1, "Calle 2"), (2, ""), (3, "a;b"), (4, "a;b;"), (5, "a;b;x"), (6, "a;b;99")], "line int, text string")
    got = {r.line: (r.name, r.address, r.trips) for r in tables.parse_point_list(lines).collect()}
    assert got == {0: ("casa", "Calle 1", 4), 1: (None, "Calle 2", 4), 3: ("a", "b", 4), 4: ("a", "b", 0), 5: ("a", "b", 4), 6: ("a", "b", 14)}


def test_tables_round_trip(spark, tmp_path):
    g = queries.graph(spark, SF)
    tables.write_graph(g, queries._cells(spark, SF).join(queries._lattice(spark, SF).select(F.col("point").alias("cell"), "lat", "lon").limit(0), "cell", "left_anti"), str(tmp_path / "g"), 4)
    back, _ = tables.read_graph(spark, str(tmp_path / "g"))
    assert back.edges.count() == g.edges.count() == 21 and back.nodes.count() == 17
    params = K.apply_aliases(K.prior_params(spark), K.slot_table(spark))
    tables.write_slots(params, str(tmp_path / "s"), ("local", "autopista", "arterial"))
    read = {r.slot: r.g for r in tables.read_slots(spark, str(tmp_path / "s")).collect()}
    assert read["punta_am"] == [1.3, 1.15, 1.35] and read["sabado"] == read["madrugada"]
    with pytest.raises(Exception, match="no factor for x"):
        tables.read_slots(spark, str(tmp_path / "s"), ("x",)).collect()
    m = spark.createDataFrame([tuple("abcdefghij")], ", ".join(f"{c} string" for c in config.MEASUREMENT_COLUMNS))
    tables.write_measurements(m, str(tmp_path / "m"))
    assert tables.read_measurements(spark, str(tmp_path / "m")).collect() == m.collect()


def test_extract(spark, tmp_path):
    import gzip
    import json

    node = lambda i, lat: {"type": "node", "id": i, "lat": lat, "lon": 1.0}
    for name, els in (("a", [node(1, 1.0), {"type": "way", "id": 5, "tags": {"highway": "primary"}, "nodes": [1, 2]}]), ("b", [node(1, 2.0), {"type": "relation", "id": 9, "tags": {"name": "Z"}, "members": []}])):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump({"elements": els}, f)
    els = extract.read_extract(spark, str(tmp_path / "*.json.gz"))
    ways, nodes = extract.merge_tiles(els)
    assert [tuple(r) for r in nodes.collect()] == [(1, 2.0, 1.0)] and ways.first().nodes == [1, 2]
    assert [r.name for r in extract.read_boundaries(els)[1].collect()] == ["Z"]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["scenario", "metric", "place", "point", "trips", "out", "back", "weekly", "total"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
