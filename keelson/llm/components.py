"""Connected components of a link table, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(a, root) for every node a that links, over some path, to a smaller one.

    links has long columns a and b, in any direction, repeats and loops allowed.
    A round moves every node's larger neighbours to its least neighbour, then
    every node to the least of its smaller ones; it needs only per-node minima
    (combined before the shuffle) and equi-joins against written tables, whose
    hot keys adaptive execution can split.  The number of rounds follows the
    logarithm of the longest path.  An empty table gives an empty one.
    """
    e = keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
        "links",
    )
    was = _mark(e)
    while was[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        e = keep(e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).distinct())
        low = keep(e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        down = e.join(low, e.a == low.u).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(low.select(F.col("u").alias("a"), F.col("m").alias("b")).unionAll(down).distinct())
        now = _mark(e)
        if now == was:
            break
        was = now
    return e.select("a", F.col("b").alias("root"))
