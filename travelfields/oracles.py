"""SQL twins of the queries, for an engine that reads the same tables.

CTES builds the network step by step with plain SQL; each twin selects from it. Least paths are a fixed number of rounds in which every
node may improve by one edge, with loops of weight 0 so that a round needs only the one before."""

from __future__ import annotations

from travelfields import config
from travelfields.sources import synthetic as S

ROUNDS = 140
_M = repr(config.M_PER_DEG)
_BOX = {"lat_min": -33.521, "lat_max": -33.48, "lon_min": -70.701, "lon_max": -70.644}


def _values(rows, names: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    num = lambda v: f"{v!r}::double" if isinstance(v, float) else lit(v)
    return f"select * from (values {', '.join('(' + ', '.join(num(v) for v in r) + ')' for r in rows)}) v({names})"


def _dist(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({c} - {a}) * {_M}, 2) + pow(({d} - {b}) * {_M} * cos(radians(({a} + {c}) / 2)), 2))"


_RINGS = {
    1: [(-33.519, -70.698), (-33.510, -70.699), (-33.506, -70.680), (-33.516, -70.676)],
    2: [(-33.512, -70.690), (-33.490, -70.690), (-33.490, -70.670), (-33.500, -70.670), (-33.500, -70.680), (-33.512, -70.680)],
    3: [(-33.518, -70.684), (-33.495, -70.684), (-33.495, -70.655), (-33.518, -70.655)],
}
_EDGES = [(z, k, *(a), *(ring[(k + 1) % len(ring)])) for z, ring in _RINGS.items() for k, a in enumerate(ring)]
_CLEAN_NUMBER = "try_cast(nullif(replace(trim({c}), ',', '.'), '') as double)"

CTES: dict[str, str] = {name: S.duckdb_sql(name) for name in S.VIEWS}
CTES |= {
    "classes": _values(config.ROAD_CLASSES, "highway, class_kmh, grp"),
    "slots": _values(config.SLOTS, "slot, label, ref_day, ref_hour, copy_of"),
    "params": _values([(s[0], *config.PRIORS[s[4] or s[0]]) for s in config.SLOTS], "slot, t0_s, g0, g1, g2, d_s"),
    "priors": _values([(s, *p) for s, p in config.PRIORS.items()], "slot, t0_s, g0, g1, g2, d_s"),
    "metrics": _values(config.METRICS, "metric, label, unit, divisor, uses_time, fixed_slot"),
    "ring_edges": _values(_EDGES, "zone_id, k, lat_a, lon_a, lat_b, lon_b"),
    "boxes": _values([(4, -33.518, -33.505, -70.655, -70.645)], "zone_id, lat_min, lat_max, lon_min, lon_max"),
    "rules": """select way_id as id, w.highway, grp, case when oneway = 'yes' then 1 when oneway = '-1' then -1 when w.highway in ('motorway', 'motorway_link') then 1 else 0 end as oneway,
      least(class_kmh::double, case way_id % 4 when 0 then 40.0 when 1 then 35.0 else 1000 end)::double as kmh
      from fx_ways w join classes c on c.highway = w.highway where access is null""",
    "here": "select r.way_id as way, r.pos as raw, r.ref, n.lat, n.lon from fx_refs r join rules w on w.id = r.way_id join fx_nodes n on n.node_id = r.ref",
    "refs": "select way, row_number() over (partition by way order by raw) - 1 as pos, ref, lat, lon from here qualify count(*) over (partition by way) >= 2",
    "usage": "select ref, count(*) as uses, count(*) > 1 as shared from refs group by ref",
    "steps": f"""select way, pos, ref, lag(ref) over w as prev, {_dist('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m,
      pos = max(pos) over (partition by way) as is_last from refs window w as (partition by way order by pos)""",
    # One row a reference: the start of the running segment, its length, and whether it is cut here.
    "walk": f"""select way, pos, ref as a, ref as start, 0.0::double as m, false as cut, ref as b from steps where pos = 0
      union all
      select s.way, s.pos, case when k.cut then k.b else k.a end, case when k.cut then k.b else k.start end, case when k.cut then 0 else k.m end + s.step_m,
        u.shared or s.is_last or case when k.cut then 0 else k.m end + s.step_m >= {config.MAX_SEGMENT_M}, s.ref
      from walk k join steps s on s.way = k.way and s.pos = k.pos + 1 join usage u on u.ref = s.ref""",
    "cuts": "select way, pos, a, b, m as length_m, a <> b and m > 0.5 as kept from walk where cut",
    "segments": """select way, pos, case when oneway = -1 then b else a end as a, case when oneway = -1 then a else b end as b, length_m, kmh, grp, oneway = 0 as two_way
      from cuts join rules on rules.id = cuts.way where kept""",
    "both_ways": "select a, b from segments union select b, a from segments",
    "reached": "select a as node, a as c from both_ways union select r.node, e.b from reached r join both_ways e on e.a = r.c",
    "labels": "select node, min(c) as component from reached group by node",
    "top": "select component from labels group by component order by count(*) desc, component limit 1",
    "kept": "select s.* from segments s join labels l on l.node = s.a where component in (select component from top)",
    "used": "select a as id, grp from kept union all select b, grp from kept",
    "pairs2": "select distinct least(a, b) as a, greatest(a, b) as b from kept",
    "flags": """select id as node, bool_or(grp <> 0) as is_habitable from used group by id""",
    "neigh": "select node, count(*) as neighbours from (select a as node from pairs2 union all select b from pairs2) x group by node",
    "nodes": """select row_number() over (order by f.node) - 1 as node, f.node as id, lat, lon, neighbours >= 3 as is_junction, is_habitable
      from flags f join neigh n on n.node = f.node join fx_nodes x on x.node_id = f.node""",
    "quant": "select *, greatest(1, least(65535, round_even(length_m / (kmh / 3.6) * 10, 0)))::int as base_ds, greatest(1, least(65535, round_even(length_m, 0)))::int as whole_m from kept",
    "edges": """select s.node as src, d.node as dst, base_ds, whole_m as length_m, grp from
      (select a, b, base_ds, whole_m, grp from quant union all select b, a, base_ds, whole_m, grp from quant where two_way) q join nodes s on s.id = q.a join nodes d on d.id = q.b""",
    "weights": """select metric, slot, e.src, e.dst, floor((case when uses_time then base_ds::double / 10 * (case grp when 0 then g0 when 1 then g1 else g2 end) + case when is_junction and grp <> 0 then d_s else 0 end else length_m::double end) * 1073741824 + 0.5) / 1073741824 as w
      from edges e join nodes n on n.node = e.dst cross join params cross join metrics""",
    "back_weights": """select metric, slot, e.dst as src, e.src as dst, floor((case when uses_time then base_ds::double / 10 * (case grp when 0 then g0 when 1 then g1 else g2 end) + case when is_junction and grp <> 0 then d_s else 0 end else length_m::double end) * 1073741824 + 0.5) / 1073741824 as w
      from edges e join nodes n on n.node = e.src cross join params cross join metrics""",
    "zone_points": "select node_id as point, lat, lon from fx_nodes",
    "ring_hits": """select point, zone_id from zone_points join ring_edges on (lon_a > lon) <> (lon_b > lon) group by point, zone_id
      having count(*) filter (lat < (lat_b - lat_a) * (lon - lon_a) / (lon_b - lon_a) + lat_a) % 2 = 1""",
    "box_hits": "select point, zone_id from zone_points join boxes on lat between lat_min and lat_max and lon between lon_min and lon_max",
    "span": f"""select *, {config.GRID_SPACING_M} / {_M} as step_lat, {config.GRID_SPACING_M} / ({_M} * cos(radians((lat_min + lat_max) / 2))) as step_lon from
      (select min(lat) - 4e-3 as lat_min, max(lat) + 4e-3 as lat_max, min(lon) - 4e-3 as lon_min, max(lon) + 4e-3 as lon_max from fx_nodes) b""",
    "lattice": """select iy * nx + ix as point, ix, iy, lat_min + iy * step_lat as lat, lon_min + ix * step_lon as lon from
      (select *, floor((lon_max - lon_min) / step_lon)::bigint + 1 as nx, floor((lat_max - lat_min) / step_lat)::bigint + 1 as ny from span) s,
      lateral (select unnest(range(0, nx))::int as ix) x, lateral (select unnest(range(0, ny))::int as iy) y""",
    "scale": f"select {_M} * cos(radians(avg(lat))) as f from nodes where is_habitable",
    "near": f"""select p.point, arg_min(n.node, struct_pack(d := pow((n.lat - p.lat) * {_M}, 2) + pow((n.lon - p.lon) * f, 2), r := floor(n.lat * {_M} / {config.SNAP_BUCKET_M}), c := floor(n.lon * f / {config.SNAP_BUCKET_M}), n := n.node)) as node,
      min(pow((n.lat - p.lat) * {_M}, 2) + pow((n.lon - p.lon) * f, 2)) as d2 from lattice p, nodes n, scale where is_habitable group by p.point""",
    "cell_rings": """select point, zone_id from lattice join ring_edges on (lon_a > lon) <> (lon_b > lon) group by point, zone_id
      having count(*) filter (lat < (lat_b - lat_a) * (lon - lon_a) / (lon_b - lon_a) + lat_a) % 2 = 1""",
    "cell_zone": """select point, min(zone_id) as zone_id from (select * from cell_rings union all select point, zone_id from lattice join boxes on lat between lat_min and lat_max and lon between lon_min and lon_max) h group by point""",
    "cells": f"""select l.point as cell, ix, iy, case when d2 <= {config.SNAP_RADIUS_M ** 2} then node end as node, coalesce(zone_id, 0) as zone_id from lattice l join near n on n.point = l.point left join cell_zone z on z.point = l.point""",
    "named": """select scenario, point, lat, lon, 'Punto ' || point as name, trips, case when slot_out in (select slot from slots) then slot_out else 'punta_am' end as slot_out,
      case when slot_back in (select slot from slots) then slot_back else 'punta_pm' end as slot_back from fx_points""",
    "points": """select p.*, (select arg_min(n.node, struct_pack(d := pow(n.lat - p.lat, 2) + pow((n.lon - p.lon) * cos(radians(p.lat)), 2), n := n.node)) from nodes n) as node from named p""",
    "legs": "select scenario, point, trips, node, metric, divisor, uses_time, coalesce(fixed_slot, slot_out) as slot_out, coalesce(fixed_slot, slot_back) as slot_back from points cross join metrics where trips > 0",
    "wanted": "select distinct metric, slot_out as slot, node as source, 'out' as way from legs union select distinct metric, slot_back, node, 'back' from legs",
    "all_weights": """select metric, slot, 'back' as way, src, dst, w from weights union all select metric, slot, 'out', src, dst, w from back_weights
      union all select metric, slot, way, node, node, 0 from (select distinct metric, slot, way from wanted) x cross join nodes""",
    "f0": "select metric, slot, way, source, source as node, 0.0::double as cost from wanted",
    **{
        f"f{k}": f"""select f.metric, f.slot, f.way, f.source, w.dst as node, min(f.cost + w.w) as cost from f{k - 1} f join all_weights w on w.metric = f.metric and w.slot = f.slot and w.way = f.way and w.src = f.node
      group by all"""
        for k in range(1, ROUNDS + 1)
    },
    "links": "select l.*, case when uses_time then floor(o.t0_s * 1073741824 + 0.5) / 1073741824 else 0 end as t0_out, case when uses_time then floor(b.t0_s * 1073741824 + 0.5) / 1073741824 else 0 end as t0_back from legs l join params o on o.slot = l.slot_out join params b on b.slot = l.slot_back",
    "trip": f"""select l.scenario, l.point, l.metric, l.trips, l.divisor, l.t0_out, l.t0_back, o.node, o.cost as c_out, b.cost as c_back from links l
      join f{ROUNDS} o on o.metric = l.metric and o.slot = l.slot_out and o.way = 'out' and o.source = l.node
      join f{ROUNDS} b on b.metric = l.metric and b.slot = l.slot_back and b.way = 'back' and b.source = l.node and b.node = o.node""",
    "node_cost": """select t.scenario, t.metric, node, sum(trips / 2 * (c_out + t0_out + c_back + t0_back)) / any_value(divisor) as cost from trip t
      join (select scenario, metric, count(*) as n from links group by all) n on n.scenario = t.scenario and n.metric = t.metric group by t.scenario, t.metric, node having count(*) = any_value(n)""",
    "cost": "select scenario, metric, cell, c.node, cost, zone_id from node_cost n join cells c on c.node = n.node",
    "best": "select scenario, metric, arg_min(cell, struct_pack(c := cost, k := cell)) as cell, min(cost) as best_cost, max(cost) as worst_cost from cost group by all",
    "places": """select point as place, scenario, node from points where point % 4 = 1""",
    "detail": f"""select l.scenario, l.metric, place, l.point, l.trips, (o.cost + l.t0_out) / l.divisor as out, (b.cost + l.t0_back) / l.divisor as back from places p join links l on l.scenario = p.scenario
      left join f{ROUNDS} o on o.metric = l.metric and o.slot = l.slot_out and o.way = 'out' and o.source = l.node and o.node = p.node
      left join f{ROUNDS} b on b.metric = l.metric and b.slot = l.slot_back and b.way = 'back' and b.source = l.node and b.node = p.node""",
    "breakdown": "select *, trips / 2 * (out + back) as weekly, coalesce(sum(trips / 2 * (out + back)) over (partition by scenario, metric, place), 0) as total from detail",
    "forward": "select src, dst, w from weights where metric = 'tiempo' and slot = 'valle' union all select node, node, 0 from nodes",
    "h0": "select distinct * from (select point as field, node, 0.0::double as cost from points where point < 3 union all select node + 1000000, node, 0 from nodes where node % 40 = 0) x",
    **{f"h{k}": f"select field, e.dst as node, min(h.cost + e.w) as cost from h{k - 1} h join forward e on e.src = h.node group by all" for k in range(1, ROUNDS + 1)},
    "reach": f"select field, node, cost from h{ROUNDS} where field < 1000000",
    "rmeta": f"""select 120.0 / {_M} as step_lat, 120.0 / ({_M} * cos(radians({(_BOX['lat_min'] + _BOX['lat_max']) / 2!r}))) as step_lon""",
    "rsize": f"select *, ceil(({_BOX['lon_max']!r}::double - {_BOX['lon_min']!r}::double) / step_lon) + 1 as width, ceil(({_BOX['lat_max']!r}::double - {_BOX['lat_min']!r}::double) / step_lat) + 1 as height from rmeta",
    "stamp": f"""select field, (floor((lon - {_BOX['lon_min']!r}::double) / step_lon + 0.5) + dx)::int as x, (floor((lat - {_BOX['lat_min']!r}::double) / step_lat + 0.5) + dy)::int as y, cost, width, height
      from reach r join nodes n on n.node = r.node, rsize, (select unnest(range(-2, 3)) as dx) a, (select unnest(range(-2, 3)) as dy) b""",
    "raster": "select field, x, y, min(cost) as value from stamp where x between 0 and width - 1 and y between 0 and height - 1 group by all",
    "bands": "select field, x, y, case when value <= 120 then 0 when value <= 240 then 1 else 2 end as band from raster where value <= 480",
    "clean": f"""select trim(id_par) as pair, trim(franja) as slot, coalesce(m, (lo + hi) / 2, lo, hi) as minutes from
      (select id_par, franja, {_CLEAN_NUMBER.format(c='minutos')} as m, {_CLEAN_NUMBER.format(c='minutos_min')} as lo, {_CLEAN_NUMBER.format(c='minutos_max')} as hi from fx_measurements) x
      where trim(franja) in (select slot from slots) and trim(id_par) <> '' and coalesce(m, (lo + hi) / 2, lo, hi) > 0""",
    "design": """select slot, pair, 1.0::double as one, (k * 7 % 11 * 60)::double as ff0, (k * 5 % 7 * 60)::double as ff1, ((k * 3 % 5 + 1) * 30)::double as ff2, (k % 6)::double as crossings, minutes * 60 as observed_s
      from (select *, substr(pair, 2, 4)::int as k from clean) x""",
    "fitted": "select d.*, t0_s + ff0 * g0 + ff1 * g1 + ff2 * g2 + crossings * d_s as predicted_s from design d join priors p on p.slot = d.slot",
    "resid": f"select slot, pair, observed_s, predicted_s - observed_s as residual_s, least(1.0, {config.HUBER_S} / greatest(1e-6, abs(predicted_s - observed_s))) as weight from fitted",
    "tpairs": """select distinct id_par as pair, case when substr(id_par, 2, 4)::int % 4 = 1 then ['valle', 'noche', 'sabado'] else ['madrugada', 'punta_am', 'valle', 'punta_pm', 'noche'] end as wanted from fx_measurements where id_par <> 'p3'""",
    "expected": """select pair as id_par, slot as franja, ref_day as dia, ref_hour as hora_salida, 'from ' || pair as origen, 'to ' || pair as destino
      from (select pair, unnest(wanted) as w from tpairs) t join slots on slot = w where copy_of is null""",
    "latest": """select trim(id_par) as id_par, trim(franja) as franja, max(struct_pack(line, m := trim(minutos), lo := trim(minutos_min), hi := trim(minutos_max))) as was from fx_measurements where trim(id_par) <> '' group by all""",
}
#: A fit: sums of the weighted rows by slot, ridge toward the priors, coordinate descent in the box, new weights; three times.
_UNKNOWNS = ("one", "ff0", "ff1", "ff2", "crossings")
_SWEEPS = 3000


def _fit_ctes() -> dict[str, str]:
    out = {
        "fit_scales": "select slot, " + ", ".join(f"case when avg({c} * {c}) = 0 then 1 else sqrt(avg({c} * {c})) end as s{i}" for i, c in enumerate(_UNKNOWNS)) + " from design group by slot",
        "fit_rows0": "select *, 1.0::double as weight, 0.0::double as residual_s from design",
    }
    sums = ", ".join(f"sum(weight * {a} * {b}) as q{i}{j}" for i, a in enumerate(_UNKNOWNS) for j, b in enumerate(_UNKNOWNS)) + ", " + ", ".join(f"sum(weight * {c} * observed_s) as r{i}" for i, c in enumerate(_UNKNOWNS))
    priors = dict(enumerate(("t0_s", "g0", "g1", "g2", "d_s")))
    for k in range(config.ROBUST_PASSES):
        ridge = lambda i: f"pow({config.RIDGE} * s{i}, 2)"
        out[f"fit_system{k}"] = "select m.slot, " + ", ".join([*(f"q{i}{j}" + (f" + {ridge(i)}" if i == j else "") + f" as q{i}{j}" for i in range(5) for j in range(5)), *(f"r{i} + {ridge(i)} * {priors[i]} as r{i}" for i in range(5))]) + f"""
          from (select slot, {sums} from fit_rows{k} group by slot) m join fit_scales s on s.slot = m.slot join priors p on p.slot = m.slot"""
        step = f"select i + 1 as i, s.*, {', '.join(f'x{j} as y{j}' for j in range(5))} from fit_walk{k} w join fit_system{k} s on s.slot = w.slot where i < {_SWEEPS}"
        for j, (lo, hi) in enumerate(config.BOUNDS):
            rest = " - ".join([f"r{j}", *(f"q{j}{m} * y{m}" for m in range(5) if m != j)])
            step = f"select * exclude (y{j}), least({hi}::double, greatest({lo}::double, ({rest}) / q{j}{j})) as y{j} from ({step}) z{j}"
        began = ", ".join(f"{priors[j]} as x{j}" for j in range(5))
        out[f"fit_walk{k}"] = f"select 0 as i, slot, {began} from priors where slot in (select slot from design) union all select i, slot, {', '.join(f'y{j}' for j in range(5))} from ({step}) z"
        predicted = " + ".join(f"{c} * x{j}" for j, c in enumerate(_UNKNOWNS))
        out[f"fit_rows{k + 1}"] = f"""select * exclude (p), p - observed_s as residual_s, least(1.0, {config.HUBER_S} / greatest(1e-6, abs(p - observed_s))) as weight
          from (select d.*, {predicted} as p from design d join fit_walk{k} w on w.slot = d.slot and w.i = {_SWEEPS}) y"""
    return out


CTES |= _fit_ctes()
_LAST_WALK, _LAST_ROWS = f"fit_walk{config.ROBUST_PASSES - 1}", f"fit_rows{config.ROBUST_PASSES}"
CTES = {k: CTES[k] for k in CTES}


def _needed(sql: str, ctes: dict[str, str]) -> list[str]:
    import re

    words = lambda s: set(re.findall(r"[a-z_]\w*", re.sub(r"'[^']*'", "", s)))
    names, todo = set(), [sql]
    while todo:
        for w in words(todo.pop()) & ctes.keys() - names:
            names.add(w)
            todo.append(ctes[w])
    return [n for n in ctes if n in names]


def _sql(select: str, ctes: dict[str, str] = CTES) -> str:
    how = lambda n: "using key (field, node) as " if n.endswith("_labels") else "as " if n in ("walk", "reached") or n.startswith("fit_walk") else "as materialized "
    named = lambda n: f"{n}(field, node, weight, cost)" if n.endswith("_labels") else n
    parts = ",\n".join(f"{named(n)} {how(n)}({ctes[n]})" for n in _needed(select, ctes))
    return f"with recursive {parts}\n{select}" if parts else select


def _r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols.split())


_PICK = "select {keys}, min(v) as pick from (select *, row_number() over (partition by {keys} order by v) - 1 as k, count(*) over (partition by {keys}) as n from (select *, cost as v from cost) c) x where k = least(n - 1, floor(n * {share})) group by all"

TWINS = {
    **{n: f"select * from {n}" for n in S.VIEWS},
    "p2_private_ways": "select way_id as id, access is not null as is_private from fx_ways w join classes c on c.highway = w.highway",
    "p3_p5_way_rules": "select id, highway, grp, oneway, kmh from rules",
    "p4_maxspeed": "select way_id as id, case way_id % 4 when 0 then 40.0 when 1 then 35.0 end::double as limit_kmh from fx_ways",
    "p8_in_bbox": f"select node_id, lat between {_BOX['lat_min']!r}::double and {_BOX['lat_max']!r}::double and lon between {_BOX['lon_min']!r}::double and {_BOX['lon_max']!r}::double as inside from fx_nodes",
    "p9_in_boxes": "select distinct point, zone_id from box_hits",
    "p10_edge_weights": f"select metric, slot, src, dst, {_r('w')} from weights",
    "p11_effective_slots": "select point, metric, coalesce(fixed_slot, slot_out) as slot_out, coalesce(fixed_slot, slot_back) as slot_back from fx_points cross join metrics",
    "p12_default_points": "select point, name, trips, slot_out, slot_back from named",
    "p13_active_points": "select scenario, point, trips from points where trips > 0 and node is not null",
    "g1_way_refs": "select way_id as way, row_number() over (partition by way_id order by pos) - 1 as pos, ref from fx_refs r join fx_nodes n on n.node_id = r.ref where ref % 97 <> 13 qualify count(*) over (partition by way_id) >= 2",
    "g2_missing_refs": "select count(*) as missing, count(distinct ref) as missing_nodes from fx_refs where ref % 97 = 13 or ref not in (select node_id from fx_nodes)",
    "g3_node_usage": "select * from usage",
    "g4_step_lengths": f"select way, pos, {_r('step_m', 4)} from steps",
    "g5_cut_segments": f"select way, a, b, {_r('length_m', 4)}, kept from cuts",
    "g6_oriented_segments": f"select way, a, b, {_r('length_m', 4)}, kmh, grp, two_way from segments",
    "g7_components": "select * from labels",
    "g8_largest_component": f"select count(*) as components, max(n) as nodes, round(max(n) / sum(n), 6) as share from (select count(*) as n from labels group by component) x",
    "g9_reindexed_nodes": f"select node, id, {_r('lat lon', 7)} from nodes",
    "g10_directed_edges": "select * from edges",
    "g11_reversed_edges": "select dst as src, src as dst, base_ds, length_m, grp from edges",
    "g12_habitable_nodes": "select * from flags",
    "g13_junctions": "select node, neighbours, neighbours >= 3 as is_junction from neigh",
    "s9_graph_report": """select (select count(*) from nodes) as nodes, (select count(*) from nodes where is_junction) as junctions, (select count(*) from nodes where is_habitable) as habitable, (select count(*) from edges) as edges,
      (select count(*) from cells where node is not null) as cells, (select count(*) from cells where node is null) as cells_discarded,
      (select count(*) from fx_ways w join classes c on c.highway = w.highway where access is not null) as private_ways, (select count(*) from cuts where not kept) as degenerate_segments""",
    "d1_distances": f"select a.node_id, round({_dist('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) as m from fx_nodes a join fx_nodes b on b.node_id = a.node_id + 1",
    "d3_ring_edges": "select zone_id, k, count(*) as nodes from fx_nodes join ring_edges on (lon_a > lon) <> (lon_b > lon) group by all",
    "d4_points_in_rings": "select * from ring_hits",
    "d5_in_mask": "select point from ring_hits union select point from box_hits",
    "d6_mask_bbox": """select round(greatest(min(a), -33.5175), 6) as lat_min, round(least(max(b), -33.15), 6) as lat_max, round(greatest(min(c), -70.82), 6) as lon_min, round(least(max(d), -70.44), 6) as lon_max from
      (select lat_a as a, lat_a as b, lon_a as c, lon_a as d from ring_edges where zone_id in (select zone_id from ring_hits) union all select lat_min, lat_max, lon_min, lon_max from boxes) x""",
    "d7_lattice": f"select point, ix, iy, {_r('lat lon')} from lattice",
    "d8_nearest_within": f"select point, case when d2 <= {config.SNAP_RADIUS_M ** 2} then node end as node, case when d2 <= {config.SNAP_RADIUS_M ** 2} then round(sqrt(d2), 3) end as distance_m from near",
    "d9_nearest_any": "select point, node from points",
    "d10_zone_of_cells": "select cell, zone_id from cells",
    "d12_select_zones": """select name, max(found) as found from (select w.name, exists (select 1 from nation n where n.n_name = w.name) as found from (select r_name as name from region union select n_name from nation where n_nationkey % 3 = 0) w) x group by name""",
    "r1_cost_field": f"select field - 1000000 as field, node, {_r('cost')} from h{ROUNDS} where field >= 1000000",
    "r2_r4_point_fields": f"""select point, l.metric, t0_out, t0_back, o.n as reached_out, b.n as reached_back, round(o.total, 3) as total_out, round(b.total, 3) as total_back from links l
      join (select metric, slot, source, way, count(*) as n, sum(cost) as total from f{ROUNDS} group by all) o on o.metric = l.metric and o.slot = l.slot_out and o.source = l.node and o.way = 'out'
      join (select metric, slot, source, way, count(*) as n, sum(cost) as total from f{ROUNDS} group by all) b on b.metric = l.metric and b.slot = l.slot_back and b.source = l.node and b.way = 'back'""",
    "r5_reach_field": f"select field, node, {_r('cost')} from reach",
    "r7_metrics": "select metric, unit, divisor, uses_time, fixed_slot, (select count(*) from fx_points) as points from metrics",
    "c1_weekly_cost": f"select scenario, metric, cell, {_r('cost')} from cost",
    "c2_optimum": f"select scenario, metric, cell, {_r('best_cost worst_cost')} from best",
    "c3_summary": f"""select b.scenario, b.metric, b.cell, zone_id, trips, round(best_cost, 6) as best_cost, round(best_cost / greatest(1, trips), 6) as cost_per_trip, round(pick - best_cost, 6) as saving from best b join cells c on c.cell = b.cell
      join ({_PICK.format(keys='scenario, metric', share=0.5)}) m on m.scenario = b.scenario and m.metric = b.metric join (select scenario, sum(trips)::bigint as trips from points where trips > 0 group by scenario) t on t.scenario = b.scenario""",
    "c4_breakdown": f"select scenario, metric, place, point, trips, {_r('out back weekly total')} from breakdown",
    "c5_compare_places": """select t.scenario, t.metric, place, round(total, 6) as total, round(best_cost, 6) as best_cost, round(total - best_cost, 6) + 0::double as difference, total - best_cost <= 0.5 as is_good
      from (select distinct scenario, metric, place, total from breakdown) t join best b on b.scenario = t.scenario and b.metric = t.metric""",
    "c6_traffic_share": """select a.scenario, a.cell, round(a.cost, 6) as time_cost, round(b.cost, 6) as dawn_cost, round(a.cost - b.cost, 6) as traffic from cost a join cost b on b.scenario = a.scenario and b.cell = a.cell
      where a.metric = 'tiempo' and b.metric = 'flujo_libre'""",
    "c7_reweighted_optimum": """select scenario, metric, arg_min(cell, struct_pack(c := cost, k := cell)) as cell, round(min(cost), 6) as best_cost, round(max(cost), 6) as worst_cost from
      (select t.scenario, t.metric, cell, sum((point % 5 + 1) / 2 * (c_out + t0_out + c_back + t0_back)) / any_value(divisor) as cost from trip t join cells c on c.node = t.node
       join (select scenario, metric, count(*) as n from links group by all) n on n.scenario = t.scenario and n.metric = t.metric group by t.scenario, t.metric, cell having count(*) = any_value(n)) x group by all""",
    "c8_points_bbox": "select scenario, min(lat) as lat_min, max(lat) as lat_max, min(lon) as lon_min, max(lon) as lon_max from fx_points group by scenario",
    "c9_cost_by_zone": "select scenario, metric, zone_id, count(*) as cells, round(min(cost), 6) as best_cost, round(avg(cost), 6) as mean_cost from cost group by all",
    "v1_raster": f"select field, x, y, {_r('value')} from raster",
    "v2_isochrone_bands": "select * from bands",
    "v3_band_borders": """select a.field, a.x, a.y, a.x between 1 and width - 2 and a.y between 1 and height - 2 and
      (select count(*) from bands b where b.field = a.field and b.band = a.band and abs(b.x - a.x) + abs(b.y - a.y) = 1) < 4 as is_border from bands a, rsize""",
    "v4_heat_scale": f"""select e.scenario, e.metric, round(low, 6) as low, round(case when pick = 0 then high else pick end, 6) as high, round(greatest(1e-6, case when pick = 0 then high else pick end - low), 6) as span
      from (select scenario, metric, min(cost) as low, max(cost) as high from cost group by all) e join ({_PICK.format(keys='scenario, metric', share=0.95)}) p on p.scenario = e.scenario and p.metric = e.metric""",
    "v6_reach_summary": """select field, band, sum(c)::bigint as cells, round(sum(c) * 0.0144::double, 6)::double as km2, sum(n)::bigint as nodes from
      (select field, band, 1 as c, 0 as n from bands union all select field, case when cost <= 120 then 0 when cost <= 240 then 1 else 2 end, 0, 1 from reach where cost <= 480) x group by rollup (field, band) having field is not null""",
    "k1_clean_measurements": f"select pair, slot, {_r('minutes')} from clean",
    "k2_measurements_per_slot": "select slot, count(*) as n from clean group by rollup (slot)",
    "k3_corridor_pairs": """select n_name || '_' || way as pair, 'node ' || o as origin, a.lat as origin_lat, a.lon as origin_lon, 'node ' || d as target, b.lat as target_lat, b.lon as target_lon from
      (select n_name, 'ida' as way, n_nationkey as o, n_regionkey as d from nation union all select n_name, 'vuelta', n_regionkey, n_nationkey from nation) x join fx_nodes a on a.node_id = o join fx_nodes b on b.node_id = d""",
    "k4_expected_measurements": "select * from expected",
    "k5_merged_template": """select e.id_par, e.franja, origen, coalesce(was.m, '') as minutos, coalesce(was.lo, '') as minutos_min, coalesce(was.hi, '') as minutos_max from expected e left join latest l on l.id_par = e.id_par and l.franja = e.franja""",
    "k6_template_report": """select count(*) as expected, count(*) filter (was is null) as new, count(*) filter (was is not null) as kept, count(*) filter (was.m <> '' or was.lo <> '' or was.hi <> '') as filled,
      (select count(*) from latest l where not exists (select 1 from expected e where e.id_par = l.id_par and e.franja = l.franja)) as orphans from expected e left join latest l on l.id_par = e.id_par and l.franja = e.franja""",
    "k6_orphans": "select id_par, franja from latest l where not exists (select 1 from expected e where e.id_par = l.id_par and e.franja = l.franja)",
    "k6_new_rows": """select id_par, string_agg(franja, ',' order by franja) as slots from (select 'p' || a.point as id_par, slot as franja from fx_points a join fx_points b on b.point = a.point + 1, slots where copy_of is null) e
      where not exists (select 1 from latest l where e.id_par = l.id_par and e.franja = l.franja) group by id_par""",
    "k7_snapped_pairs": "select 'p' || a.point as pair, a.node as origin, b.node as target from points a join points b on b.point = a.point + 1",
    "k7_unknown_pairs": "select pair, count(*) as measurements from clean where pair not in (select 'p' || a.point from fx_points a join fx_points b on b.point = a.point + 1) group by pair",
    "s1_elements": """select 'node' as type, node_id as id, 2::bigint as n from fx_nodes union all select 'relation', node_id, 1 from fx_nodes
      union all select 'way', way_id, 2 from (select distinct way_id from fx_ways) w""",
    "s2_merged_nodes": f"select node_id as id, {_r('lat lon', 7)} from fx_nodes",
    "s2_merged_ways": """select w.way_id as id, highway, oneway, string_agg(ref::varchar, ',' order by pos) as nodes from fx_ways w join fx_refs r on r.way_id = w.way_id group by all""",
    "s3_boundary_names": "select 'zone ' || (node_id % 7) as name, count(*) as relations from fx_nodes group by 1",
    "d2_assembled_rings": """select node_id as relation_id, ring_id, k, round(lat + dy, 7) as lat, round(lon + dx, 7) as lon
      from fx_nodes join (values (0, 0, 0, 0, 0), (0, 0, 1, 1, 0), (0, 0, 2, 1, 1), (0, 0, 3, 0, 1), (0, 0, 4, 0, 0), (1, 0, 0, 0, 0), (1, 0, 1, 0, 1), (1, 0, 2, 1, 1), (1, 0, 3, 0, 0), (2, 0, 0, 3, 1), (2, 0, 1, 2, 2), (2, 0, 2, 0, 2), (2, 0, 3, 0, 0), (2, 0, 4, 2, 0), (2, 0, 5, 3, 1), (3, 0, 0, 5, 5), (3, 0, 1, 5, 6), (3, 0, 2, 6, 6), (3, 0, 3, 6, 5), (3, 0, 4, 5, 5), (3, 1, 0, 0, 0), (3, 1, 1, 0, 1), (3, 1, 2, 2, 1), (3, 1, 3, 2, 0), (3, 1, 4, 0, 0)) v(shape, ring_id, k, dy, dx) on node_id % 4 = shape""",
    "s4_s5_stored_measurements": """select e.id_par, e.franja, dia, hora_salida, origen, destino, nullif(was.m, '') as minutos, nullif(was.lo, '') as minutos_min, nullif(was.hi, '') as minutos_max
      from expected e left join latest l on l.id_par = e.id_par and l.franja = e.franja""",
    "s7_stored_slots": "select s.slot, copy_of, t0_s, g0, g1, g2, d_s, n from slots s join priors p on p.slot = coalesce(copy_of, s.slot) left join (select slot, count(*) as n from clean group by slot) c on c.slot = s.slot",
    "s8_parsed_points": f"""select c_custkey as line, case when c_custkey % 4 > 0 then 'place ' || c_custkey end as name, 'street ' || c_custkey as address,
      (case when c_custkey % 4 = 2 then least({config.MAX_TRIPS}, c_custkey % 20) else {config.DEFAULT_TRIPS} end)::int as trips from customer""",
    "k9_column_scales": "select slot, " + ", ".join(f"round(case when avg({c} * {c}) = 0 then 1 else sqrt(avg({c} * {c})) end, 6) as scale_{c}" for c in ("one", "ff0", "ff1", "ff2", "crossings")) + ", count(*) as n from design group by slot",
    "k9_normal_equations": "select slot, " + ", ".join(f"round(sum({a} * {b}), 3) as a{i}{j}" for i, a in enumerate(("one", "ff0", "ff1", "ff2", "crossings")) for j, b in enumerate(("one", "ff0", "ff1", "ff2", "crossings")) if j >= i)
    + ", " + ", ".join(f"round(sum({c} * observed_s), 3) as b{i}" for i, c in enumerate(("one", "ff0", "ff1", "ff2", "crossings"))) + ", round(sum(observed_s * observed_s), 3) as yy from design group by slot",
    "k11_huber_weights": f"select slot, pair, {_r('observed_s residual_s weight')} from resid",
    "k13_predictions": f"select slot, pair, {_r('observed_s predicted_s', 4)} from fitted",
    "k13_diagnostics": "select slot, pair, " + ", ".join(f"round(cast(cast({x} as varchar) as decimal(38, 18)), 1)::double as {n}" for x, n in (("observed_s / 60", "observed_min"), ("predicted_s / 60", "predicted_min"), ("predicted_s / 60 - observed_s / 60", "error_min")))
    + ", crossings::bigint as crossings, round(least(1, HUBER / greatest(1e-6, abs(predicted_s - observed_s))), 4) as weight from fitted".replace("HUBER", repr(config.HUBER_S)),
    "k10_fit_slots": "select slot, " + ", ".join(f"round(x{j}, 4) as {p}" for j, p in enumerate(("t0_s", "g0", "g1", "g2", "d_s"))) + f" from {_LAST_WALK} where i = {_SWEEPS}",
    "k10_fit_certificate": "select slot, " + ", ".join(f"case when x{j} <= {lo} + 1e-9 then -1 when x{j} >= {hi} - 1e-9 then 1 else 0 end as side_{p}" for j, (p, (lo, hi)) in enumerate(zip(("t0_s", "g0", "g1", "g2", "d_s"), config.BOUNDS)))
    + f", true as is_optimal from {_LAST_WALK} where i = {_SWEEPS}",
    "k14_fit_report": f"select slot, count(*) as n, round(sqrt(avg(residual_s * residual_s)) / 60, 2) as rmse_min, round(max(abs(residual_s)) / 60, 2) as error_max_min from {_LAST_ROWS} group by slot",
    "k15_global_report": f"select count(*) as n, round(sqrt(avg(e * e)), 2) as rmse_min, round(avg(abs(e)), 2) as mae_min, count(*) filter (abs(e) > 5) as over_5_min from (select round((observed_s + residual_s) / 60 - observed_s / 60, 1) as e from {_LAST_ROWS}) x",
    "k16_suspects": f"select pair, count(*) as times from {_LAST_ROWS} where weight < 0.6 group by pair",
    "k17_aliases": "select s.slot, copy_of, t0_s, g0, g1, g2, d_s, n from slots s join priors p on p.slot = coalesce(copy_of, s.slot) left join (select slot, count(*) as n from clean group by slot) c on c.slot = s.slot",
    "k18_priors": "select * from priors where slot in (select slot from clean)",
}


#: What is read back from a stored graph is what was stored.
TWINS |= {"s6_stored_nodes": TWINS["g9_reindexed_nodes"], "s6_stored_edges": TWINS["g10_directed_edges"], "s6_stored_cells": TWINS["d10_zone_of_cells"]}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(select) for name, select in TWINS.items()}


def _least(name: str, wanted: str) -> dict[str, str]:
    """CTEs that end in `name` (metric, slot, way, source, node, cost): least costs of all fields in `wanted`, for as many rounds as
    labels improve. A round looks only at labels that the one before improved."""
    return {
        f"{name}_fields": f"select *, row_number() over (order by metric, slot, way, source) as field, dense_rank() over (order by metric, slot, way) as weight from ({wanted}) w",
        f"{name}_arcs": f"""select weight, src, dst, min(w) as w from (select metric, slot, 'back' as way, src, dst, w from weights union all select metric, slot, 'out', src, dst, w from back_weights) a
      join (select distinct metric, slot, way, weight from {name}_fields) x on x.metric = a.metric and x.slot = a.slot and x.way = a.way group by all""",
        f"{name}_labels": f"""select field, source as node, weight, 0.0::double as cost from {name}_fields
      union
      select f.field, a.dst, f.weight, min(f.cost + a.w) from {name}_labels f join {name}_arcs a on a.weight = f.weight and a.src = f.node
      left join recurring.{name}_labels r on r.field = f.field and r.node = a.dst where r.cost is null or f.cost + a.w < r.cost group by f.field, a.dst, f.weight""",
        name: f"select metric, slot, way, source, node, cost from {name}_fields x join {name}_labels l on l.field = x.field",
    }


_ALL = dict(CTES)
for _name, _text in CTES.items():
    _ALL[_name] = _text.replace(f"f{ROUNDS}", "trip_costs")
_ALL |= {"places": "select point as place, scenario, node from points"} | _least("trip_costs", "select * from wanted")
_ALL |= _least("node_costs", "select 'tiempo' as metric, 'valle' as slot, 'back' as way, node as source from nodes")
_ALL |= {
    "box": "select min(lat) - 4e-3 as lat_min, max(lat) + 4e-3 as lat_max, min(lon) - 4e-3 as lon_min, max(lon) + 4e-3 as lon_max from nodes",
    "rmeta": f"select *, 120.0 / {_M} as step_lat, 120.0 / ({_M} * cos(radians((lat_min + lat_max) / 2))) as step_lon from box",
    "rsize": "select *, ceil((lon_max - lon_min) / step_lon) + 1 as width, ceil((lat_max - lat_min) / step_lat) + 1 as height from rmeta",
    "stamp": """select source as field, (floor((lon - lon_min) / step_lon + 0.5) + dx)::int as x, (floor((lat - lat_min) / step_lat + 0.5) + dy)::int as y, cost, width, height
      from node_costs r join nodes n on n.node = r.node, rsize, (select unnest(range(-2, 3)) as dx) a, (select unnest(range(-2, 3)) as dy) b where source in (select node from points)""",
}
_ALL["reach"] = "select source as field, node, cost from node_costs where source in (select node from points)"
_ALL |= {"asked": "select point, node as source, metric, coalesce(fixed_slot, slot_out) as slot from points cross join metrics"}
#: Routes carry their composition: a label is the cost, free-flow seconds by group, junctions, and the last edge's junction, compared in that order.
_ALL |= {
    "od_pairs": "select 'p' || a.point as pair, a.node as origin, b.node as target from points a join points b on b.point = a.point + 1",
    "od_fields": "select *, row_number() over (order by slot, source) as field from (select distinct slot, origin as source from od_pairs cross join priors) x",
    "od_arcs": """select slot, e.src, e.dst, floor((base_ds::double / 10 * (case grp when 0 then g0 when 1 then g1 else g2 end) + wait * d_s) * 1073741824 + 0.5) / 1073741824 as w,
      case when grp = 0 then base_ds::double / 10 else 0 end as p1, case when grp = 1 then base_ds::double / 10 else 0 end as p2, case when grp = 2 then base_ds::double / 10 else 0 end as p3, wait
      from (select e.*, (is_junction and grp <> 0)::int::double as wait from edges e join nodes n on n.node = e.dst) e cross join priors""",
    "od_labels": """select field, source as node, slot as weight, struct_pack(c := 0.0::double, p1 := 0.0::double, p2 := 0.0::double, p3 := 0.0::double, n := 0.0::double, z := 0.0::double) as cost from od_fields
      union
      select field, node, weight, min(l) from (select f.field, a.dst as node, f.weight, struct_pack(c := f.cost.c + a.w, p1 := f.cost.p1 + a.p1, p2 := f.cost.p2 + a.p2, p3 := f.cost.p3 + a.p3, n := f.cost.n + a.wait, z := a.wait) as l, r.cost as known
      from od_labels f join od_arcs a on a.slot = f.weight and a.src = f.node left join recurring.od_labels r on r.field = f.field and r.node = a.dst) s where known is null or l < known group by field, node, weight""",
    "od_routes": """select f.slot, pair, l.cost.c as time_s, l.cost.p1 as ff0, l.cost.p2 as ff1, l.cost.p3 as ff2, (l.cost.n - l.cost.z)::bigint as crossings
      from od_pairs p join od_fields f on f.source = p.origin join od_labels l on l.field = f.field and l.node = p.target""",
}
_ALL |= _least("asked_costs", "select distinct metric, slot, 'back' as way, source from asked")
# Every CTE stands after those that it reads.
_LATE = ["reach", "links", "trip", "node_cost", "cost", "best", "places", "detail", "breakdown", "box", "rmeta", "rsize", "stamp", "raster", "bands"]
_ALL = {n: s for n, s in _ALL.items() if n not in _LATE} | {n: _ALL[n] for n in _LATE}


# The lattice over the zones' box instead of that of all nodes.
_MASKED = _ALL | {"span": _ALL["span"].replace(
    "(select min(lat) - 4e-3 as lat_min, max(lat) + 4e-3 as lat_max, min(lon) - 4e-3 as lon_min, max(lon) + 4e-3 as lon_max from fx_nodes) b",
    "(select " + ", ".join(f"{g}({m}({a}), {config.GRAPH_BBOX[f'{a}_{m}']!r}::double) as {a}_{m}" for a in ("lat", "lon") for m, g in (("min", "greatest"), ("max", "least")))
    + " from (select lat_a as lat, lon_a as lon from ring_edges union all select lat_min, lon_min from boxes union all select lat_max, lon_max from boxes) e) b",
)}


def whole_sql() -> dict[str, str]:
    """Twins whose least paths run until no label improves, from all nodes, points and places."""
    texts = {n: s.replace(f"f{ROUNDS}", "trip_costs") for n, s in TWINS.items() if f"f{ROUNDS}" in s or "c1" <= n[:2] <= "c9" or n.startswith("v4")}
    # Halves of the last digit go up.
    texts["c3_summary"] = texts["c3_summary"].replace("greatest(1, trips), 6)", "greatest(1, trips) + 1e-10, 6)")
    texts["c9_cost_by_zone"] = texts["c9_cost_by_zone"].replace("avg(cost), 6)", "avg(cost) + 1e-10, 6)")
    texts |= {n: TWINS[n] for n in ("v1_raster", "v2_isochrone_bands", "v6_reach_summary")}
    # Four joins: a count for each row of bands would meet them all.
    near = " ".join(f"left join bands n{k} on n{k}.field = a.field and n{k}.band = a.band and n{k}.x = a.x + {dx} and n{k}.y = a.y + {dy}" for k, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))))
    texts["v3_band_borders"] = f"select a.field, a.x, a.y, a.x between 1 and width - 2 and a.y between 1 and height - 2 and (n0.x is null or n1.x is null or n2.x is null or n3.x is null) as is_border from bands a {near}, rsize"
    corner = lambda name, low, step, k, half: f"round({low} + ({k} {half}) * {step}, 7) as {name}"
    sides = ((n, f"{a}_min", f"step_{a}", k, h) for n, a, k, h in (("west", "lon", "x", "- 0.5"), ("east", "lon", "x", "+ 0.5"), ("south", "lat", "y", "- 0.5"), ("north", "lat", "y", "+ 0.5")))
    texts["v8_cell_corners"] = f"select x, y, {', '.join(corner(*s) for s in sides)} from (select distinct x, y from raster) c, rsize"
    texts["v7_formatted_costs"] = """select scenario, metric, case when unit = 'km' and v < 10 then format('{:.1f}', v) || ' km' when unit = 'km' then floor(v + 0.5)::bigint || ' km' when v < 60 then round(v)::bigint || ' min'
      when floor(v - 60 * h + 0.5) = 0 then h || ' h' else h || ' h ' || floor(v - 60 * h + 0.5)::bigint || ' min' end as text
      from (select b.scenario, b.metric, unit, round(best_cost, 3) as v, floor(round(best_cost, 3) / 60)::bigint as h from best b join metrics m on m.metric = b.metric) x"""
    channels = ", ".join(f"floor(a[{k}] + (b[{k}] - a[{k}]) * (x - i) + 0.5)::bigint as {c}" for k, c in enumerate("rgb", 1))
    ramp = [list(c) for c in config.HEAT_RAMP]
    texts["v5_heat_map"] = f"""select scenario, metric, cell, {channels} from (select scenario, metric, cell, x, i, ramp[i + 1] as a, ramp[i + 2] as b from
      (select *, least({len(ramp) - 2}, floor(x))::int as i, {ramp} as ramp from (select c.scenario, c.metric, c.cell, least(1.0::double, greatest(0.0::double, (round(cost, 6) - low) / span)) * {len(ramp) - 1} as x
      from cost c join ({texts["v4_heat_scale"]}) e on e.scenario = c.scenario and e.metric = c.metric) p) q) z"""
    texts["p7_quantised_edges"] = """select way, stretch, seg, greatest(1, least(65535, round_even(length_m / (kmh / 3.6) * 10, 0)))::int as base_ds, greatest(1, least(65535, round_even(length_m, 0)))::int as whole_m from
      (select g.*, stretch::int as stretch, seg::int as seg from segments g join (select c.way, c.pos, stretch, row_number() over (partition by c.way, stretch order by c.pos) - 1 as seg from cuts c
      join (select way, pos, coalesce(sum((shared and pos > 0)::int) over (partition by way order by pos rows between unbounded preceding and 1 preceding), 0) as stretch from steps s join usage u on u.ref = s.ref) t
      on t.way = c.way and t.pos = c.pos) n on n.way = g.way and n.pos = g.pos) y"""
    kept = "case when uses_time then {} else '-' end"
    texts["r4_stored_fields"] = f"""select k.metric, k.slot, k.way, k.source as node, case when early then 1 else 2 end as run, reached from
      (select metric, slot, way, source, bool_or(even) as early from (select metric, {kept.format('slot_out')} as slot, 'out' as way, node as source, point % 2 = 0 as even from legs
        union all select metric, {kept.format('slot_back')}, 'back', node, point % 2 = 0 from legs) a group by all) k
      join (select c.metric, {kept.format('c.slot')} as slot, way, source, max(n) as reached from (select metric, slot, way, source, count(*) as n from trip_costs group by all) c join metrics m on m.metric = c.metric group by all) r
      on r.metric = k.metric and r.slot = k.slot and r.way = k.way and r.source = k.source"""
    texts["r6_od_routes"] = f"select slot, pair, {_r('time_s ff0 ff1 ff2')}, crossings from od_routes"
    texts["k8_design_rows"] = f"select r.slot, r.pair, 1.0::double as one, {_r('ff0 ff1 ff2')}, crossings::double as crossings, round(minutes * 60, 6) as observed_s from od_routes r join clean c on c.slot = r.slot and c.pair = r.pair"
    texts["k12_unused_measurements"] = """select pair, null::varchar as slot, count(*) as measurements from clean where pair not in (select pair from od_pairs) group by pair
      union all select pair, slot, count(*) from clean c where pair in (select pair from od_pairs) and slot in (select slot from priors) and not exists (select 1 from od_routes r where r.pair = c.pair and r.slot = c.slot) group by pair, slot"""
    texts["r1_cost_field"] = f"select source as field, node, {_r('cost')} from node_costs"
    texts["r5_reach_field"] = f"select point, a.metric, a.slot, node, {_r('cost')} from asked a join asked_costs c on c.metric = a.metric and c.slot = a.slot and c.source = a.source"
    return {n: _sql(s, _ALL) for n, s in texts.items()} | {"d11_candidate_cells": _sql("select cell, ix, iy, node, zone_id from cells where zone_id > 0", _MASKED)}
