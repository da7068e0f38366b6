"""Measurements, graphs, slot parameters and place lists at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from travelfields import config
from travelfields.operators.streets import StreetGraph


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV with a header, all columns text."""
    schema = ", ".join(f"{c} string" for c in config.MEASUREMENT_COLUMNS)
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


def write_measurements(df: DataFrame, path: str) -> None:
    df.select(*config.MEASUREMENT_COLUMNS).write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def _packed(c: str):
    return F.bround(F.col(c) * 1e7, 0).cast("int").alias(c)


def write_graph(graph: StreetGraph, cells: DataFrame, path: str, buckets: int = 64) -> None:
    """Nodes, edges and cells as Parquet, coordinates as whole 1e-7 degrees; edges are partitioned by ranges of their source."""
    graph.nodes.select("node", "id", _packed("lat"), _packed("lon"), "is_junction", "is_habitable").write.parquet(f"{path}/nodes")
    graph.edges.repartitionByRange(buckets, "src").sortWithinPartitions("src").write.parquet(f"{path}/edges")
    cells.withColumn("lat", _packed("lat")).withColumn("lon", _packed("lon")).write.parquet(f"{path}/cells")


def read_graph(spark: SparkSession, path: str) -> tuple[StreetGraph, DataFrame]:
    degrees = lambda df: df.withColumn("lat", F.col("lat") / 1e7).withColumn("lon", F.col("lon") / 1e7)
    nodes, edges, cells = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "cells"))
    return StreetGraph(degrees(nodes), edges), degrees(cells)


def write_slots(params: DataFrame, path: str, groups=config.GROUPS) -> None:
    """params: slot, label, ref_day, ref_hour, copy_of, t0_s, g, d_s; with the names of the groups that g follows."""
    params.withColumn("groups", F.array(*(F.lit(g) for g in groups))).write.json(path)


def read_slots(spark: SparkSession, path: str, groups=config.GROUPS) -> DataFrame:
    """Factors in the order of `groups`, found by name; a missing group is an error, a missing delay is 0."""
    raw = spark.read.schema("slot string, label string, ref_day string, ref_hour string, copy_of string, t0_s double, g array<double>, d_s double, groups array<string>").json(path)
    named = F.map_from_arrays("groups", "g")
    picked = F.array(*(F.coalesce(named[g], F.raise_error(F.lit(f"no factor for {g}")).cast("double")) for g in groups))
    return raw.withColumn("g", picked).withColumn("d_s", F.coalesce("d_s", F.lit(0.0))).drop("groups")


def parse_point_list(lines: DataFrame) -> DataFrame:
    """lines: line, text. `address`, `name; address` or `name; address; trips`, one place a line. Trips are rounded half up and kept
    within 0..14; a missing or wrong number is the default, an empty third field is 0."""
    text = F.trim(F.regexp_replace("text", "^\\s+|\\s+$", ""))
    parts = F.transform(F.split(text, ";"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    rows = lines.where(text != "").select("line", parts.alias("p"))
    third = F.get("p", F.lit(2))
    number = F.when(third == "", 0.0).when(third.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), third.try_cast("double"))
    trips = F.greatest(F.lit(0), F.least(F.lit(config.MAX_TRIPS), F.floor(number + 0.5))).cast("int")
    many = F.size("p") >= 2
    return rows.select(
        "line", F.when(many, F.get("p", F.lit(0))).alias("name"), F.when(many, F.get("p", F.lit(1))).otherwise(F.get("p", F.lit(0))).alias("address"),
        F.when(many & number.isNotNull(), trips).otherwise(F.lit(config.DEFAULT_TRIPS)).alias("trips"),
    )
