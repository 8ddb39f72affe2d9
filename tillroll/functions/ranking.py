"""Global ordering helpers that avoid a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import cut_lineage


def dense_index(df: DataFrame, key_cols: list[str], out_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """0-based dense rank of the distinct key values, ascending.

    Distinct keys are range-partitioned (so partition i holds only keys below
    those of partition i+1), numbered inside each partition, and shifted by
    the running count of the preceding partitions. The only global step is a
    window over one row per partition. The ranged table is checkpointed so the
    partition ids used for numbering and for counting are the same.
    """
    keys = df.select(*key_cols).distinct()
    ranged = (keys.repartitionByRange(num_partitions, *key_cols) if num_partitions
              else keys.repartitionByRange(*key_cols))
    tagged = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))
    local = tagged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*key_cols)) - 1)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: a broadcast whose size is the partition count
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
                 .select(*key_cols, (F.col("_off") + F.col("_local")).cast("long").alias(out_col)))
