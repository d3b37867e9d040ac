"""Order over a whole table without one task for all rows.

Rows are dealt into ranges and written, once: Spark finds the bounds of ranges
by sampling, and two plans that deal the same rows may find different ones, so
what is summed over a range must be read from the rows that were dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, parts


def ranged(df: DataFrame, by: list[Column | str], name: str = "ranged") -> DataFrame:
    """df, written, with `_part`: the number of its range of rows in the given order."""
    n = parts(df.sparkSession)
    return keep(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), name)


def _offsets(r: DataFrame, total: Column, over: Column) -> DataFrame:
    """(_p, _before): what the ranges before each one come to; a row for each range."""
    per = r.groupBy("_part").agg(total.alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(F.col("_part").alias("_p"), over.over(earlier).alias("_before"))


def _along(df: DataFrame, by: list, total: Column, over: Column, local: Column) -> DataFrame:
    r = ranged(df, by)
    here = Window.partitionBy("_part").orderBy(*by)
    return r.withColumn("_here", local.over(here.rowsBetween(Window.unboundedPreceding, 0))).join(
        F.broadcast(_offsets(r, total, over)), F.col("_part") == F.col("_p")
    )


def with_position(df: DataFrame, by: list[Column | str], name: str = "pos") -> DataFrame:
    """df with its rows' places, from 1, in the given order; ties fall somehow."""
    got = _along(df, by, F.count(F.lit(1)), F.sum("_s"), F.count(F.lit(1)))
    return got.withColumn(name, (F.col("_here") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_here", "_p", "_before")


def with_sum(df: DataFrame, by: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to and with each row in the given order, which should have no ties."""
    got = _along(df, by, F.sum(value), F.sum("_s"), F.sum(value))
    return got.withColumn(name, F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_part", "_here", "_p", "_before")


def with_max(df: DataFrame, by: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the greatest value up to and with each row in the given order."""
    got = _along(df, by, F.max(value), F.max("_s"), F.max(value))
    return got.withColumn(name, F.greatest("_here", "_before")).drop("_part", "_here", "_p", "_before")


def with_last(df: DataFrame, by: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the last value that isn't null up to and with each row in the given order, which should have no ties."""
    r = ranged(df, by)
    here = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    some = r.filter(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, F.struct(*by)).alias("_s"))
    every = r.select("_part").distinct().join(some.withColumnRenamed("_part", "_q"), F.col("_part") == F.col("_q"), "left")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = every.select(F.col("_part").alias("_p"), F.last("_s", ignorenulls=True).over(earlier).alias("_before"))
    got = r.withColumn("_here", F.last(value, ignorenulls=True).over(here)).join(F.broadcast(offs), F.col("_part") == F.col("_p"))
    return got.withColumn(name, F.coalesce("_here", "_before")).drop("_part", "_here", "_p", "_before")


def with_rank(df: DataFrame, group: list[str], by: list[Column | str], name: str = "rank") -> DataFrame:
    """df with its rows' places, from 1, within groups in the given order; a group spreads over as many ranges as it fills."""
    r = keep(with_position(df, [*group, *by], "_at"), "placed")
    first = r.groupBy(*group).agg(F.min("_at").alias("_first")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first")
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    got = r.join(first, on).withColumn(name, F.col("_at") - F.col("_first") + 1)
    return got.drop("_at", "_first", *[f"_g{i}" for i in range(len(group))])


def byte_size(*cols: str) -> Column:
    """Bytes of the given string columns of a row; null counts as none."""
    out = F.lit(0).cast("long")
    for c in cols:
        out = out + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return out
