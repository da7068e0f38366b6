"""Contracted tiles, bounded routes, stored fields, cell covers, pyramids, rank picks and calibration against plain Python."""

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from travelfields import config
from travelfields.operators import calibration as K
from travelfields.operators import hierarchy as H
from travelfields.operators import routing as R
from travelfields.operators import spatial as D
from travelfields.operators import surfaces as V
from travelfields.operators.cost import rank_pick
from travelfields.operators.field_store import FieldStore


def _least(adj, source):
    best, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for v, w in adj.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return best


@pytest.mark.parametrize("n,links,dense", [(1, 0, 24), (30, 60, 24), (120, 420, 24), (120, 900, 4), (80, 2000, 0)])
def test_contracted_tiles_equal_dijkstra(monkeypatch, n, links, dense):
    monkeypatch.setattr(H, "DENSE_LINKS", dense)
    rng = np.random.default_rng(n + links)
    src, dst, w = rng.integers(0, n, links), rng.integers(0, n, links), rng.integers(1, 500, links) / 64
    border = rng.random(n) < 0.2
    h = H.contract(n, src, dst, w, border)
    assert sorted(h["order"].tolist()) == list(range(n)) and border[h["order"]].tolist() == sorted(border.tolist())
    adj = defaultdict(list)
    for a, b, c in zip(src.tolist(), dst.tolist(), w.tolist()):
        adj[a].append((b, c))
    sources = sorted(set(rng.integers(0, n, 6).tolist()))
    cost, fields, known = H.start(h, pd.DataFrame({"field": range(len(sources)), "node": sources, "cost": 0.0}))
    assert known.all()
    H.sweep(h, cost)
    for f, s in enumerate(sources):
        want = _least(adj, s)
        assert {int(v): c for v, c in zip(h["order"], cost[:, f]) if np.isfinite(c)} == want
    # The border's part alone leads from border to border.
    first = n - int(border.sum())
    rim = H.part(h, first)
    if border.any():
        b = int(rim["order"][0])
        cost, _, _ = H.start(rim, pd.DataFrame({"field": [0], "node": [b], "cost": [0.0]}))
        H.sweep(rim, cost)
        want = _least(adj, b)
        assert {int(v): c for v, c in zip(rim["order"], cost[:, 0]) if np.isfinite(c)} == {v: c for v, c in want.items() if border[v]}


def _streets(spark, side=8, seed=5):
    """A lattice of streets over several tiles, with one-way streets and a node that no street meets."""
    rng = np.random.default_rng(seed)
    nodes = [(r * side + c, -33.5 + 0.004 * r, -70.7 + 0.004 * c, True, True) for r in range(side) for c in range(side)] + [(side * side, -33.4, -70.6, False, True)]
    edges = []
    for r in range(side):
        for c in range(side):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < side and c + dc < side:
                    a, b, ds, grp = r * side + c, (r + dr) * side + c + dc, int(rng.integers(50, 900)), int(rng.integers(0, 3))
                    edges.append((a, b, ds, ds // 2, grp))
                    if rng.random() < 0.8:
                        edges.append((b, a, ds, ds // 2, grp))
    return (
        spark.createDataFrame(nodes, "node long, lat double, lon double, is_junction boolean, is_habitable boolean"),
        spark.createDataFrame(edges, "src long, dst long, base_ds int, length_m int, grp int"),
    )


def test_fields_over_many_tiles_equal_plain(spark):
    nodes, edges = _streets(spark)
    w = edges.select(F.lit("x").alias("weight_id"), "src", "dst", (F.col("base_ds") / 7).alias("w"))
    src = spark.createDataFrame([(k, "x", n) for k, n in enumerate([*range(0, 64, 5), 64])], "field long, weight_id string, node long")
    plain = {(r.field, r.node): r.cost for r in R.cost_field_plain(w, src).collect()}
    for deg in (0.009, None):
        got = R.cost_field(w, src, nodes, deg).collect()
        assert len(got) == len(plain) and {(r.field, r.node): r.cost for r in got} == plain
    assert plain[13, 64] == 0.0 and sum(f == 13 for f, _ in plain) == 1


def _routes(nodes, edges, pairs, g, d):
    """Best (time, ff0, ff1, ff2, crossings) by a heap over labels, the end's own junction left out."""
    junction = {r.node: r.is_junction for r in nodes}
    adj = defaultdict(list)
    for r in edges:
        wait = float(junction[r.dst] and r.grp != config.NO_DELAY_GROUP)
        w = math.floor((r.base_ds / 10 * g[r.grp] + wait * d) / config.COST_UNIT + 0.5) * config.COST_UNIT
        adj[r.src].append((r.dst, w, [r.base_ds / 10 if r.grp == k else 0.0 for k in range(3)], wait))
    out = {}
    for pair, origin, target in pairs:
        heap, seen = [((0.0, 0.0, 0.0, 0.0, 0.0, 0.0), origin)], set()
        while heap:
            label, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen.add(u)
            if u == target:
                out[pair] = (*label[:4], int(label[4] - label[5]))
                break
            for v, w, ff, wait in adj[u]:
                heapq.heappush(heap, ((label[0] + w, *(a + b for a, b in zip(label[1:4], ff)), label[4] + wait, wait), v))
    return out


def test_routes_go_no_farther_than_their_targets(spark, monkeypatch):
    nodes, edges = _streets(spark)
    slots = K.prior_params(spark).where("slot = 'valle'").select("slot", "g", "d_s")
    pairs = [("near", 0, 1), ("near2", 0, 8), ("mid", 20, 37), ("self", 9, 9), ("far", 0, 27), ("lost", 3, 64), ("back", 63, 54)]
    s = slots.first()
    table = spark.createDataFrame(pairs, "pair string, origin long, target long")
    want = _routes(nodes.collect(), edges.collect(), pairs, s.g, s.d_s)
    relax, sizes = R._relax, []

    def counted(*args):
        out = relax(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "_relax", counted)
    for deg in (0.013, None):
        got = {r.pair: (r.time_s, r.ff0, r.ff1, r.ff2, r.crossings) for r in R.od_routes(table, edges, nodes, slots, deg).collect()}
        assert got.keys() == want.keys() and "lost" not in got
        assert all(np.allclose(got[p], want[p], rtol=1e-12) for p in want)
    # Origins 0, 9, 20 and 63 see a part of the network, 3 looks for its lost target everywhere.
    close = [p for p in ("near", "self", "mid") if p in want]
    near = R.od_routes(table.where(F.col("pair").isin(close)), edges, nodes, slots, None).count()
    assert near == len(close) > 1 and sizes[-1] < len(close) * 64 * 0.6
    assert all(n < 5 * 64 * 0.8 for n in sizes)


def test_stored_fields_are_routed_once(spark, tmp_path):
    nodes, edges = _streets(spark, 5)
    params = K.prior_params(spark).join(K.slot_table(spark).select("slot"), "slot")
    metrics = R.metric_catalogue(spark)
    rows = [(1, k, 3 * k, 2, "valle", "noche") for k in range(6)] + [(2, 6, 3, 1, "noche", "valle"), (2, 7, 0, 5, "punta_am", "valle")]
    points = spark.createDataFrame(rows, "scenario long, point long, node long, trips int, slot_out string, slot_back string")
    store = FieldStore(str(tmp_path), edges, nodes, params, metrics)
    assert store.keys().count() == 0 and store.fields(points.limit(0).select(F.lit(0).alias("field_out"), F.lit(0).alias("field_back"))).count() == 0
    first, more = store.extend(points.where("point < 3")), store.extend(points)
    assert first > 0 and more > 0 and store.extend(points) == 0
    again = FieldStore(str(tmp_path), edges, nodes, params, metrics)
    assert again.path == store.path and again.extend(points) == 0
    links, fields = R.point_fields(points, edges, nodes, params, metrics)
    assert first + more == fields.select("field").distinct().count()

    def legs(links, fields):
        out = links.join(fields.toDF("field_out", "node", "c_out"), "field_out").join(fields.toDF("field_back", "node", "c_back"), ["field_back", "node"])
        return Counter((r.point, r.metric, r.node, r.c_out, r.c_back, r.t0_out, r.t0_back, r.trips) for r in out.collect())

    mine = store.links(points)
    assert legs(mine, store.fields(mine)) == legs(links, fields)
    some = mine.where("metric = 'distancia'")
    assert {"metric=distancia"} == {p for f in store.fields(some).inputFiles() for p in f.split("/") if p.startswith("metric=")}
    other = FieldStore(str(tmp_path), edges.where("src <> 0"), nodes, params, metrics)
    assert other.path != store.path and other.keys().count() == 0


def test_ranks_are_picked_by_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.exponential(1, 500)] + [("b", 3.0)] * 70 + [("c", float(k)) for k in range(11)] + [("d", 1e300), ("d", 1e-300), ("d", 0.0)] + [("e", None)] + [("f", float(v)) for v in rng.integers(0, 9, 300)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for k in "abcdf":
            v = sorted(x for y, x in rows if y == k)
            want[k] = v[min(len(v) - 1, math.floor(len(v) * share))]
        for how in ({}, {"window_rows": 3, "ranges": 4}):
            assert {r.k: r.m for r in rank_pick(df, ["k"], "v", share, "m", **how).collect()} == want


def test_cells_of_rings_equal_ray_casting(spark):
    rng = np.random.default_rng(8)
    rings = {}
    for z in range(1, 5):
        angle = np.sort(rng.random(9 + z)) * 2 * math.pi
        size = 0.004 + rng.random(len(angle)) * 0.006
        ring = [(-33.5 + 0.003 * z + s * math.sin(a), -70.7 + 0.004 * z + s * math.cos(a)) for a, s in zip(angle, size)]
        rings[z] = [(float(a), float(b)) for a, b in (*ring, ring[0])]
    rings[5] = [(-33.5, -70.7), (-33.5, -70.69), (-33.49, -70.69), (-33.49, -70.7), (-33.5, -70.7)]
    points = [(k, -33.515 + float(a) * 0.035, -70.715 + float(b) * 0.04) for k, (a, b) in enumerate(rng.random((1500, 2)))]
    points += [(2000 + k, lat, lon) for k, (lat, lon) in enumerate(v for r in rings.values() for v in r)] + [(3000, -33.495, -70.7), (3001, -33.5, -70.695), (3002, 10.0, 10.0)]

    def inside(lat, lon, ring):
        odd = False
        for (la, oa), (lb, ob) in zip(ring, ring[1:]):
            if (oa > lon) != (ob > lon) and lat < (lb - la) * (lon - oa) / (ob - oa) + la:
                odd = not odd
        return odd

    want = {(p, z) for p, lat, lon in points for z, ring in rings.items() if inside(lat, lon, ring)}
    edges = spark.createDataFrame([(z, 0, k, *a, *b) for z, r in rings.items() for k, (a, b) in enumerate(zip(r, r[1:]))], "zone_id int, ring_id int, k int, lat_a double, lon_a double, lat_b double, lon_b double")
    table = spark.createDataFrame(points, "point long, lat double, lon double")
    for bucket in (0.002, 0.0005, 0.05):
        got = [(r.point, r.zone_id) for r in D.points_in_rings(table, edges, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert D.points_in_rings(table, edges.limit(0)).count() == 0 == D.points_in_rings(table.limit(0), edges).count()


def test_nearest_node_from_far_off_and_over_a_dense_centre(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_NODES", 40)
    monkeypatch.setattr(D, "LEAF_NODES", 4)
    rng = np.random.default_rng(4)
    at = np.concatenate([np.array([-33.45, -70.65]) + rng.normal(0, 0.002, (300, 2)), np.array([-33.4, -70.6]) + rng.random((60, 2)) * 0.4])
    nodes = [(k, float(a), float(b)) for k, (a, b) in enumerate(at)] + [(900, float(at[3][0]), float(at[3][1])), (901, -33.2, -70.2), (902, -33.2, -70.2)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.array([-33.45, -70.65]) + rng.normal(0, 0.05, (80, 2)))] + [(100, 40.0, 20.0), (101, -33.0, 179.0), (102, 89.0, 0.0), (103, -33.2, -70.2), (104, float(at[3][0]), float(at[3][1]))]

    def brute(lat, lon):
        c = math.cos(math.radians(lat))
        return min((((b - lon) * c) ** 2 + (a - lat) ** 2, n) for n, a, b in nodes)

    table, grid = spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(nodes, "node long, lat double, lon double")
    got = {r.point: r.node for r in D.nearest_any(table, grid).collect()}
    of = {n: (a, b) for n, a, b in nodes}
    for p, lat, lon in points:
        d2, n = brute(lat, lon)
        a, b = of[got[p]]
        c = math.cos(math.radians(lat))
        assert got[p] == n or math.isclose(((b - lon) * c) ** 2 + (a - lat) ** 2, d2, rel_tol=1e-12)
    assert got[103] == 901 and got[104] == 3
    assert {r.node for r in D.nearest_any(table, grid.limit(0)).collect()} == {None}


def test_nearest_within_over_a_dense_centre(spark, monkeypatch):
    rng = np.random.default_rng(9)
    nodes = [(k, -33.45 + float(a), -70.65 + float(b)) for k, (a, b) in enumerate(rng.normal(0, 0.003, (400, 2)))] + [(500, -33.45, -70.65), (501, -33.45, -70.65), (502, -33.3, -70.6)]
    points = [(k, -33.45 + float(a), -70.65 + float(b)) for k, (a, b) in enumerate(rng.normal(0, 0.006, (150, 2)))] + [(200, -33.45, -70.65), (201, 0.0, 0.0)]
    table, grid = spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(nodes, "node long, lat double, lon double")
    want = {r.point: (r.node, r.distance_m) for r in D.nearest_within(table, grid).collect()}
    monkeypatch.setattr(D, "BUCKET_NODES", 10)
    monkeypatch.setattr(D, "LEAF_NODES", 4)
    assert {r.point: (r.node, r.distance_m) for r in D.nearest_within(table, grid).collect()} == want
    assert want[200][0] == 500 and want[201] == (None, None) and sum(n is None for n, _ in want.values()) > 3


def test_stamps_equal_naive_ones(spark):
    rng = np.random.default_rng(6)
    box = {"lat_min": -33.5, "lat_max": -33.48, "lon_min": -70.7, "lon_max": -70.67}
    nodes = [(k, -33.503 + float(a) * 0.026, -70.703 + float(b) * 0.036) for k, (a, b) in enumerate(rng.random((60, 2)))]
    field = [(f, k, float(rng.integers(1, 900))) for f in (1, 2) for k in range(60) if rng.random() < 0.7]
    m = V.raster_meta(box)
    want, of = {}, {k: (a, b) for k, a, b in nodes}
    for f, k, c in field:
        cx, cy = math.floor((of[k][1] - box["lon_min"]) / m["step_lon"] + 0.5), math.floor((of[k][0] - box["lat_min"]) / m["step_lat"] + 0.5)
        for x in range(cx - 2, cx + 3):
            for y in range(cy - 2, cy + 3):
                if 0 <= x < m["width"] and 0 <= y < m["height"]:
                    want[f, x, y] = min(c, want.get((f, x, y), math.inf))
    got = V.rasterise(spark.createDataFrame(field, "field long, node long, cost double"), spark.createDataFrame(nodes, "node long, lat double, lon double"), box)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.field, r.x, r.y): r.value for r in rows} == want


def _replay(nodes, edges, pairs, seen):
    """The alternation of routes and fits in plain Python. seen: (slot, pair, minutes)."""
    lo, hi = np.array(config.BOUNDS).T
    out = {}
    for slot in config.FITTED_SLOTS:
        prior = np.array(config.PRIORS[slot])
        state, best = prior[1:].copy(), (None, tuple(prior))
        for _ in range(config.ROUTE_PASSES):
            routes = _routes(nodes, edges, pairs, state[:3], state[3])
            rows = [(routes[p], 60 * m) for s, p, m in seen if s == slot and p in routes]
            if len(rows) < 3:
                continue
            a, y = np.array([[1.0, r[1], r[2], r[3], float(r[4])] for r, _ in rows]), np.array([t for _, t in rows])
            scale = np.sqrt((a * a).mean(0))
            ridge = (config.RIDGE * np.where(scale == 0, 1.0, scale)) ** 2
            weight = np.ones(len(y))
            for _ in range(config.ROBUST_PASSES):
                x = K.solve_box((a * weight[:, None]).T @ a + np.diag(ridge), (a * weight[:, None]).T @ y + ridge * prior, lo, hi)
                weight = np.minimum(1, config.HUBER_S / np.maximum(1e-6, np.abs(a @ x - y)))
            rmse = round(float(np.sqrt((((a @ x) - y) ** 2).mean()) / 60), 2)
            fit = (round(x[0], 1), *(round(v, 4) for v in x[1:4]), round(x[4], 2))
            if best[0] is None or rmse < best[0]:
                best = (rmse, fit)
            state = config.DAMPING * np.array(fit[1:]) + (1 - config.DAMPING) * state
        out[slot] = best[1]
    return out


def test_calibration_from_places(spark):
    nodes, edges = _streets(spark, 6)
    rng = np.random.default_rng(12)
    ends = {f"q{k}": (int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, 36, (14, 2))) if a != b}
    ends["lost"] = (3, 36)
    at = {r.node: (r.lat, r.lon) for r in nodes.collect()}
    places = spark.createDataFrame([(p, *at[a], *at[b]) for p, (a, b) in ends.items()], "pair string, origin_lat double, origin_lon double, target_lat double, target_lon double")
    seen = [(s, p, float(rng.integers(4, 40))) for s in config.FITTED_SLOTS for p in ends if s != "noche"] + [("noche", "q0", 12.0), ("noche", "lost", 9.0), ("valle", "nobody", 7.0), ("sabado", "q1", 8.0)]
    clean = spark.createDataFrame([(p, s, m) for s, p, m in seen], "pair string, slot string, minutes double")
    got = K.calibrate_places(clean, places, edges, nodes, K.slot_table(spark))
    want = _replay(nodes.collect(), edges.collect(), [(p, *e) for p, e in ends.items()], seen)
    params = {r.slot: tuple(r)[1:] for r in got.params.collect()}
    assert all(np.allclose(params[s], want[s], atol=2e-4) for s in want) and params["noche"] == config.PRIORS["noche"]
    assert params["sabado"] == params["madrugada"]
    assert [tuple(r) for r in got.unknown.collect()] == [("nobody", 1)]
    assert Counter((r.slot, r.pair) for r in got.unrouted.collect()) == Counter((s, "lost") for s in config.FITTED_SLOTS)
    rows = got.diagnostics.collect()
    assert len(rows) == sum(s in want and s != "noche" and p in ends and p != "lost" for s, p, _ in seen)
    overall = got.overall.first()
    e = np.array([r.error_min for r in rows])
    assert overall.n == len(rows) and math.isclose(overall.rmse_min, round(float(np.sqrt((e * e).mean())), 2), abs_tol=0.011)
    assert {r.slot for r in got.report.collect()} == set(config.FITTED_SLOTS) - {"noche"}


def test_fits_are_optimal_and_say_so(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"p{k}", 1.0, *(float(v) for v in rng.integers(0, 900, 3)), float(rng.integers(0, 9)), float(rng.integers(200, 4000))) for s in ("valle", "noche") for k in range(30)]
    table = spark.createDataFrame(rows, "slot string, pair string, one double, ff0 double, ff1 double, ff2 double, crossings double, observed_s double")
    cert = K.fit_certificate(table).collect()
    assert len(cert) == 2 and all(r.is_optimal for r in cert)
    with pytest.raises(ValueError):
        K.solve_box(np.array([[1.0, 0.9999], [0.9999, 1.0]]), np.array([1.0, -1.0]), np.full(2, -1e9), np.full(2, 1e9), sweeps=3)


def test_routes_don_t_look_for_what_is_out_of_reach(spark, monkeypatch):
    nodes, edges = _streets(spark)
    slots = K.prior_params(spark).where("slot = 'valle'").select("slot", "g", "d_s")
    relax, seen = R._relax, []

    def counted(*args):
        seen.append((args[1].count(), relax(*args)))
        return seen[-1][1]

    monkeypatch.setattr(R, "_relax", counted)
    table = spark.createDataFrame([("lost", 3, 64), ("near", 0, 1)], "pair string, origin long, target long")
    assert [r.pair for r in R.od_routes(table, edges, nodes, slots, None).collect()] == ["near"]
    assert seen[0][0] == 1 and seen[0][1].count() == 1
