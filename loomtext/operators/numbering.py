"""Dense numbers and running totals over a whole table, without a task that holds it:
rows are ranged to partitions, and partitions get the totals of those before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.sources.shared import checkpointed

_AT = (1 << 33) - 1


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows in order, written down with their partition and their place in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.withColumn("__row", F.monotonically_increasing_id()))
    return rows.withColumn("__part", F.shiftright("__row", 33))


def _before(rows: DataFrame, total) -> DataFrame:
    """(__part, __first): the total of all partitions before; a row a partition."""
    sums = rows.groupBy("__part").agg(total.alias("__sum"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__first")))


def numbered(df: DataFrame, order: list, name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with numbers from ``start`` in an order."""
    rows = _ranged(df, order)
    at = F.col("__first") + F.col("__row").bitwiseAND(_AT) + start
    return rows.join(_before(rows, F.count("*")), "__part").withColumn(name, at).drop("__part", "__row", "__first")


def totals_before(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows."""
    rows = _ranged(df, order)
    own = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__first") + F.coalesce(F.sum(value).over(own), F.lit(0))
    return rows.join(_before(rows, F.sum(value)), "__part").withColumn(name, at).drop("__part", "__row", "__first")
