"""A street network, measurements and places derived from the sample tables part, supplier, customer and events.

Each view is one SQL text in two dialects, so that results can be compared with another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from travelfields import config

_CLASSES = ", ".join(f"'{c[0]}'" for c in config.ROAD_CLASSES)

VIEWS = {
    "fx_nodes": """
select p_partkey as node_id,
  cast(-335200000 + (p_partkey // 50)*9000 + ((p_partkey*7919)%101 - 50)*10 as double)/1e7 as lat,
  cast(-707000000 + (p_partkey % 50)*11000 + ((p_partkey*104729)%103 - 51)*10 as double)/1e7 as lon
from part""",
    "fx_refs": """
select way_id, pos,
  case when t='h' then 5*(way_id // 5)*50 + (way_id%5)*10 + pos
       when t='v' then ((way_id-r)//10*10 + pos)*50 + 5*((way_id-r)%10)
       else ((5*(way_id%10)+2)%r)*50 + (way_id%9)*5 + 2 + pos%(2+way_id%4) end as ref
from (select s_suppkey as way_id, r,
        case when s_suppkey<r then 'h' when s_suppkey<2*r then 'v' else 'x' end as t
      from supplier cross join (select count(*)//50 as r from part) k) w
cross join (select unnest(range(0,11)) as pos) g
where (t='h' and (way_id%5)*10+pos < 50)
   or (t='v' and (way_id-r)//10*10+pos < r)
   or (t='x' and pos < 2+way_id%4 + case when way_id%3=0 then 1 else 0 end)""",
    "fx_ways": f"""
select way_id, case when way_id%29=17 then 'service' else ARRAY({_CLASSES}) end as highway,
  case when way_id%37=5 then 'private' end as access,
  case when way_id%11=3 then 'yes' when way_id%11=7 then '-1' end as oneway,
  case way_id%4 when 0 then '40' when 1 then '35 km/h' when 2 then 'signals' end as maxspeed
from (select distinct way_id from fx_refs) w""",
    "fx_measurements": """
select event_id as line, 'p'||cast(user_id%18 as varchar) as id_par,
  case event_id%8 when 0 then 'madrugada' when 1 then 'punta_am' when 2 then 'valle' when 3 then 'punta_pm'
    when 4 then 'noche' when 5 then 'sabado' when 6 then ' valle ' else 'otra' end as franja,
  case when event_type in ('error','signup') then ''
       else cast(cast(floor(value*10) as bigint)//10 as varchar)||','||cast(cast(floor(value*10) as bigint)%10 as varchar) end as minutos,
  case when event_type='signup' then cast(event_id%40 as varchar) else '' end as minutos_min,
  case when event_type='signup' and event_id%3<>0 then cast(event_id%40+10 as varchar) else '' end as minutos_max
from events""",
    "fx_points": """
select c_custkey // 4 as scenario, c_custkey as point,
  cast(-335200000 + ((c_custkey*37)%n // 50)*9000 + 2000 as double)/1e7 as lat,
  cast(-707000000 + ((c_custkey*37)%n % 50)*11000 - 3000 as double)/1e7 as lon,
  c_custkey%15 as trips,
  case c_custkey%4 when 0 then 'punta_am' when 1 then 'valle' when 2 then 'madrugada' else 'nope' end as slot_out,
  case c_custkey%3 when 0 then 'punta_pm' when 1 then 'noche' else 'valle' end as slot_back
from customer cross join (select count(*) as n from part) k""",
}


def duckdb_sql(name: str) -> str:
    sql = VIEWS[name]
    return sql.replace(f"ARRAY({_CLASSES})", f"([{_CLASSES}])[way_id%13+1]")


def spark_sql(name: str) -> str:
    sql = VIEWS[name].replace("//", " div ").replace("varchar", "string").replace("unnest(range(0,11))", "explode(sequence(0,10))")
    return sql.replace(f"ARRAY({_CLASSES})", f"array({_CLASSES})[way_id%13]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    sql, views = spark_sql(name), {}
    for t in ("part", "supplier", "customer", "events"):
        if f"from {t}" in sql or name == "fx_ways":
            views[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "fx_ways":
        sql = sql.replace("from fx_refs", f"from ({spark_sql('fx_refs')}) f")
    for t, df in views.items():
        df.createOrReplaceTempView(f"_fx_{t}")
        sql = sql.replace(f"from {t}", f"from _fx_{t}")
    return spark.sql(sql)


def ways_and_nodes(spark: SparkSession, sf_dir: str, gap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ways (id, tags, nodes) and nodes (id, lat, lon); gap leaves out the nodes with node_id % 97 = gap."""
    refs = table(spark, sf_dir, "fx_refs").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref"))).alias("r"))
    tags = F.map_filter(F.create_map(*(x for k in ("highway", "access", "oneway", "maxspeed") for x in (F.lit(k), F.col(k)))), lambda k, v: v.isNotNull())
    ways = table(spark, sf_dir, "fx_ways").join(refs, "way_id").select(F.col("way_id").alias("id"), tags.alias("tags"), F.transform("r", lambda x: x["ref"]).alias("nodes"))
    nodes = table(spark, sf_dir, "fx_nodes").withColumnRenamed("node_id", "id")
    return ways, nodes if gap is None else nodes.where(F.col("id") % 97 != gap)


def zone_rings(spark: SparkSession) -> DataFrame:
    """(zone_id, ring_id, k, lat, lon): a convex ring, an L-shaped one, and one that overlaps both; in the south-west of the network."""
    rings = {
        1: [(-33.519, -70.698), (-33.510, -70.699), (-33.506, -70.680), (-33.516, -70.676)],
        2: [(-33.512, -70.690), (-33.490, -70.690), (-33.490, -70.670), (-33.500, -70.670), (-33.500, -70.680), (-33.512, -70.680)],
        3: [(-33.518, -70.684), (-33.495, -70.684), (-33.495, -70.655), (-33.518, -70.655)],
    }
    rows = [(z, 0, k, lat, lon) for z, ring in rings.items() for k, (lat, lon) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, "zone_id int, ring_id int, k int, lat double, lon double")


def zone_boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(4, -33.518, -33.505, -70.655, -70.645)], "zone_id int, lat_min double, lat_max double, lon_min double, lon_max double")


def slot_params(spark: SparkSession) -> DataFrame:
    """(slot, t0_s, g, d_s) of all slots, from the priors; copies have their source's."""
    rows = [(s[0], p[0], list(p[1:4]), p[4]) for s in config.SLOTS for p in (config.PRIORS[s[4] or s[0]],)]
    return spark.createDataFrame(rows, "slot string, t0_s double, g array<double>, d_s double")
