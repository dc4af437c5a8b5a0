"""Computations over the global order without one big partition.

Rows are range-partitioned by the order and written once with their partition
number.  A window per partition gives local results; what crosses a border
(sums, counts, last values) is one row per partition, and only those rows meet
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

ORDER = ("part", "seq")


def ranged(df: DataFrame, order=ORDER) -> DataFrame:
    """The rows with ``_p``, a partition number that rises with the order."""
    return stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")


def _local(order):
    return Window.partitionBy("_p").orderBy(*order)


def running_total(df: DataFrame, value: Column, name: str, order=ORDER, inclusive: bool = False) -> DataFrame:
    """Sum of ``value`` over all earlier rows (and this one, if inclusive)."""
    rows = ranged(df.withColumn("_v", value), order)
    totals = rows.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = 0 if inclusive else -1
    own = F.coalesce(F.sum("_v").over(_local(order).rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
    return rows.withColumn("_own", own).join(before, "_p").withColumn(name, F.col("_own") + F.col("_before")).drop("_p", "_v", "_own", "_before")


def numbered(df: DataFrame, name: str, order=ORDER) -> DataFrame:
    """Global row number from 1."""
    return running_total(df, F.lit(1), name, order, inclusive=True)


def neighbours(df: DataFrame, value: Column, before: str | None = None, after: str | None = None, order=ORDER) -> DataFrame:
    """The value of the row before and after in the global order."""
    rows = ranged(df.withColumn("_v", value), order)
    key = F.struct(*order)
    ends = rows.groupBy("_p").agg(F.min_by(F.struct("_v"), key).alias("_f"), F.max_by(F.struct("_v"), key).alias("_l"))
    across = Window.orderBy("_p")
    ends = ends.select("_p", F.lag("_l").over(across).alias("_l"), F.lead("_f").over(across).alias("_f"))
    out = rows.withColumns({"_b": F.lag(F.struct("_v")).over(_local(order)), "_a": F.lead(F.struct("_v")).over(_local(order))}).join(ends, "_p")
    new = {}
    if before:
        new[before] = F.coalesce("_b", "_l")["_v"]
    if after:
        new[after] = F.coalesce("_a", "_f")["_v"]
    return out.withColumns(new).drop("_p", "_v", "_b", "_a", "_l", "_f")


def islands(df: DataFrame, key: Column, name: str, order=ORDER) -> DataFrame:
    """A number for each run of consecutive rows with equal keys."""
    near = neighbours(df.withColumn("_k", F.struct(key.alias("k"))), F.col("_k"), before="_kb", order=order)
    change = F.when(F.col("_kb").isNull() | ~F.col("_k").eqNullSafe(F.col("_kb")), 1).otherwise(0)
    return running_total(near, change, name, order, inclusive=True).drop("_k", "_kb")
