"""A number for every row in one order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.settle import settle

ROWS = 500_000  # rows of a range that more ranges than the session's partitions would cut


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with `name`, a long: 1, 2, 3 ... in the given order over all rows.

    Rows are dealt to ranges of the order and written, so a range's rows stay the same when a task runs again; only the
    number of rows of each range reaches the driver, and a window numbers each range by itself. Rows alike in every
    column of the order lie in one range: let the order end in an id. Null ids sort as the order says; an empty table
    gives no rows.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    many = df.count()
    ranges = max(min(ranges, -(-many // 1000)), -(-many // ROWS), 1)
    ranged = settle(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row a range
        offsets.append((r["_range"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "_range int, _before long")
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")
