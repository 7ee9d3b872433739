"""Running values over long ordered groups, in two levels.

A window over a whole file is one task's work however long the file is. Here a
group is cut into segments of positions: each segment is scanned on its own,
and what goes from one to the next is a window over one row for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 1 << 16


def carried_all(rows: DataFrame, keys: list[str], position: str, values: dict[str, Column], segment: int = SEGMENT) -> DataFrame:
    """``rows`` with the last non-null of each of ``values`` at or before each row's position, by name; null before the first."""
    names = list(values)
    cut = rows.withColumn("_segment", F.floor(F.col(position) / segment)).withColumns({f"_value_{n}": v for n, v in values.items()})
    within = Window.partitionBy(*keys, "_segment").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_local_{n}": F.last(f"_value_{n}", ignorenulls=True).over(within) for n in names})
    # a segment takes what the last segment before it ended with, if it is not a neighbour's too
    ends = cut.groupBy(*keys, "_segment").agg(*[F.max_by(f"_value_{n}", F.when(F.col(f"_value_{n}").isNotNull(), F.col(position))).alias(f"_end_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_segment", *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in names])
    return local.join(carry, [*keys, "_segment"], "left").select(*rows.columns, *[F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n) for n in names])


def carried(rows: DataFrame, keys: list[str], position: str, value: Column, name: str, segment: int = SEGMENT) -> DataFrame:
    """``carried_all`` of one value."""
    return carried_all(rows, keys, position, {name: value}, segment)


def running_sum(rows: DataFrame, keys: list[str], position: str, value: Column, name: str, inclusive: bool = True, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with the sum of ``value`` (a bigint) over the group's rows up to each position as ``name``."""
    cut = rows.withColumn("_segment", F.floor(F.col(position) / segment)).withColumn("_value", value)
    within = Window.partitionBy(*keys, "_segment").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_value").over(within) - (F.lit(0) if inclusive else F.col("_value")))
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, "_segment").agg(F.sum("_value").alias("_sum")).select(*keys, "_segment", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    return local.join(carry, [*keys, "_segment"]).select(*rows.columns, (F.col("_local") + F.col("_carry")).cast("bigint").alias(name))
