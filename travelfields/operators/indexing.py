"""Dense numbering of rows in the order of a key, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from travelfields.shared import write_shared


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name` (long), 0 to N-1 in the order of the distinct key.

    Rows are range partitioned and numbered inside their range; only one count for each range is
    added up across ranges. The range of a row is fixed by writing it first."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = write_shared(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "index-cut")
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    return cut.withColumn("_k", inside).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_k") + F.col("_offset")).cast("long")).drop("_range", "_k", "_offset")
