"""Order over a whole table without putting it into one task: range parts, then local windows and per-part offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, parts


def ranged(df: DataFrame, *by, name: str = "ranged") -> DataFrame:
    """df, written, with `_p`: the number of its range of rows by the given order."""
    n = parts(df.sparkSession)
    return keep(df.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id()), name)


def running(df: DataFrame, value: str, group: list[str], by: list, out: str) -> DataFrame:
    """df from ranged() over group and then by, with `out`: the sum of value over earlier rows of the group.

    A part holds one range of rows, so a hot group spreads over many parts;
    the rows that meet for one group's offsets are as many as its parts.
    """
    local = Window.partitionBy("_p", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    mine = df.withColumn(out, F.coalesce(F.sum(value).over(local), F.lit(0)))
    per = df.groupBy("_p", *group).agg(F.sum(value).alias("_s"))
    over = Window.partitionBy(*group) if group else Window
    before = over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = keep(per.select("_p", *group, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")), "offsets")
    per = per.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before")
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    got = mine.join(per, on, "left").withColumn(out, F.col(out) + F.col("_before"))
    return got.drop("_q", "_before", *[f"_g{i}" for i in range(len(group))])
