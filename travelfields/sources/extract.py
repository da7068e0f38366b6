"""Cached map extracts: gzip JSON tiles with an array of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ELEMENTS = (
    "elements array<struct<type: string, id: bigint, lat: double, lon: double, nodes: array<bigint>, tags: map<string, string>, "
    "members: array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>>>"
)


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """(tile, type, id, lat, lon, nodes, tags, members), one row an element."""
    raw = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("tile"), F.explode("elements").alias("e")).select("tile", "e.*")


def merge_tiles(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes): tiles overlap; of rows with one id the last tile's stays."""

    def last(kind: str, *cols: str) -> DataFrame:
        newest = F.row_number().over(W.partitionBy("id").orderBy(F.desc("tile")))
        return elements.where(F.col("type") == kind).withColumn("k", newest).where("k = 1").select("id", *cols)

    return last("way", "tags", "nodes"), last("node", "lat", "lon")


def read_boundaries(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with name, sorted distinct names)."""
    rel = elements.where("type = 'relation'").withColumn("name", F.col("tags")["name"])
    return rel.select("id", "name", "members"), rel.select("name").where("name is not null").distinct().orderBy("name")
