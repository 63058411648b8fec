"""Running sums over an order of a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.state import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum of a column over the rows before each row in the order (0 for the first). Rows that
    tie in the order come in any order among themselves.

    The rows are range-partitioned, sums inside a range are added to those of the ranges before it; the driver and the
    broadcast see one row for each range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    heads = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__range", *[before(f"__{n}", earlier).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(heads), "__range").withColumns({n: F.col(f"__{n}") + before(c, inside) for n, c in sums.items()})
    return out.select(*df.columns, *sums)
