"""Global ranks that never pull one group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut


def ordered_index(
    df: DataFrame, group: list[str], order: list, name: str = "position"
) -> DataFrame:
    """Number the rows of each group from 0 in the given total order.

    Rows are range-partitioned on (group, order), so a group holding most of
    the table is spread over many partitions. Each partition numbers its own
    rows; the per-partition counts (one row per partition and group) are summed
    into offsets. The ranged table is written once so both uses see the same
    partition bounds.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group] + list(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(parts, *keys).withColumn("_slice", F.spark_partition_id()),
        "ranged",
    )
    local = Window.partitionBy("_slice", *group).orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local) - 1)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_rows"))
        .select(
            *group, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
        )
    )
    return (
        numbered.join(offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_slice", "_local", "_offset")
    )


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to this one, in the given total order.

    As above: every range sums its own rows, and one row per range gives the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()), "ranged")
    first = Window.unboundedPreceding
    local = F.sum(value).over(Window.partitionBy("_slice").orderBy(*order).rowsBetween(first, 0))
    sums = ranged.groupBy("_slice").agg(F.sum(value).alias("_sum"))
    # One row per range, in one task.
    offsets = sums.select("_slice", F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(first, -1)), F.lit(0)).alias("_offset"))
    return ranged.withColumn("_local", local).join(offsets, "_slice").withColumn(name, F.col("_local") + F.col("_offset")).drop("_slice", "_local", "_offset")


def top_rows(df: DataFrame, group: list[str], order: list, limit: int, name: str = "place") -> DataFrame:
    """First ``limit`` rows per group, 1-based.

    The filter on ``row_number`` lets Spark keep at most ``limit`` rows per
    group in every map task before the shuffle, so a hot group stays small.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
