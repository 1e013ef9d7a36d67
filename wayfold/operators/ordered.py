"""Work along one order of a whole table, without a task that sees all of it.

A table is put into ranges of the order, one range a task, and written with the
number of its range and a number that rises along the order (``ordered``). What a
range needs of those before it is then a sum for each range, so the only window
over all of something is one over the ranges, of which there are as many as tasks.

* ``numbered``: the place of each row in the order, from 0.
* ``running``: sums of all rows up to each one.
* ``sliding``: aggregates of each row and the next ``width`` - 1, in segments that
  borrow the first rows of the next one.

Rows that are equal in the order have no set order among themselves; nulls come
first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize

RANGE, AT, NUMBER = "__range", "__at", "__number"
#: Rows of a segment.
SEGMENT = 1 << 16


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """The table in ranges of the order, with the range and a number along the order that may have gaps."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranges.withColumns({RANGE: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "ordered")


def _before(parts: DataFrame, names: list[str]) -> DataFrame:
    """Of a row for each range: the sums of the ranges before it."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return parts.select(RANGE, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """The table with the place of each row in the order, from 0, as ``__number``."""
    table = ordered(df, *order)
    parts = table.groupBy(RANGE).agg(F.count("*").alias("n"), F.min(AT).alias("first"))
    shift = _before(parts, ["n"]).join(parts.select(RANGE, "first"), RANGE).select(RANGE, (F.col("n_before") - F.col("first")).alias("shift"))
    return table.join(shift, RANGE).withColumn(NUMBER, F.col(AT) + F.col("shift")).select(*df.columns, NUMBER)


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """The table with the sum of a column over all rows up to each one, for each name and column of ``sums``."""
    table = ordered(df, *order)
    parts = table.groupBy(RANGE).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    inside = Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    within = table.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = within.join(_before(parts, list(sums)), RANGE)
    return out.select(*df.columns, *((F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums))


def sliding(df: DataFrame, order: list[Column | str], width: int, aggregates: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """The table with aggregates over each row and the ``width`` - 1 rows after it (fewer at the end), given as functions of a window."""
    if width < 1:
        raise ValueError("a window has one row at least")
    size = max(SEGMENT, 8 * width)
    rows = numbered(df, *order).withColumn("__segment", F.floor(F.col(NUMBER) / size))
    place = F.col(NUMBER) % size
    # The first rows of a segment also stand behind the last of the one before, and in as many more as the window reaches.
    owners = F.when((place < width - 1) & (F.col("__segment") > 0), F.array(F.col("__segment"), F.col("__segment") - 1)).otherwise(F.array("__segment"))
    dealt = rows.withColumn("__owner", F.explode(owners))
    window = Window.partitionBy("__owner").orderBy(NUMBER).rowsBetween(0, width - 1)
    found = dealt.withColumns({n: f(window) for n, f in aggregates.items()})
    return found.where("__owner = __segment").select(*df.columns, *aggregates)
