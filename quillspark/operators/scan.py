"""Prefix scans over ordered rows of a group, without the group in one task.

Rows are sorted by range, so a group's rows lie in one or more ranges, one after the other. A range is summed up by itself;
what comes before it is the sum over the ranges before, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep


def equal(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """The condition that two frames' columns are equal, nulls with nulls."""
    on = a[cols[0]].eqNullSafe(b[cols[0]])
    for c in cols[1:]:
        on = on & a[c].eqNullSafe(b[c])
    return on


def running(rows: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Rows with running sums (this row's included) over their group in an order without ties. Sums are longs or doubles."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kinds = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    t = keep(rows.orderBy(*by, *order).withColumns({**kinds, "_part": F.spark_partition_id(), "_at": at}))
    total = t.groupBy("_part", *by).agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = total.select("_part", *by, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({n: F.sum(n).over(inside) for n in sums})
    out = t.join(before, equal(t, before, ["_part", *by]), "left").select(*[t[c] for c in t.columns if c not in sums], *[(t[n] + before[f"_sum_{n}"]).alias(n) for n in sums])
    return out.drop("_part", "_at")


def previous(rows: DataFrame, by: list[str], order: list[str], **cols: Column) -> DataFrame:
    """Rows with values of the row before in their group's order; null for a group's first."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    t = keep(rows.orderBy(*by, *order).withColumns({**{f"_val_{n}": c for n, c in cols.items()}, "_part": F.spark_partition_id(), "_at": at}))
    last = t.groupBy("_part", *by).agg(F.max_by(F.struct(*[f"_val_{n}" for n in cols]), "_at").alias("_last"))
    before = last.select("_part", *by, F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")).alias("_before"))  # a row for each range
    inside = Window.partitionBy("_part", *by).orderBy("_at")
    t = t.withColumn("_own", F.lag(F.struct(*[f"_val_{n}" for n in cols])).over(inside))
    out = t.join(before, equal(t, before, ["_part", *by]), "left").withColumn("_x", F.coalesce("_own", "_before"))
    return out.select(*[t[c] for c in rows.columns], *[F.col(f"_x._val_{n}").alias(n) for n in cols])
