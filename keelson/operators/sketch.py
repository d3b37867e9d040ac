"""Membership and frequency sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest count that a 4-bit counter holds.
TOP = 15


class Bloom:
    """Membership of a string or long column, by the JVM's Bloom filter; built by a distributed aggregate.

    bits() is stable, so a filter can be stored and read again.
    """

    def __init__(self, jvm_filter):
        self.f = jvm_filter

    @classmethod
    def of(cls, df: DataFrame, col: str, expected: int, fpp: float = 0.01) -> Bloom:
        return cls(df._jdf.stat().bloomFilter(col, expected, fpp))

    def might_contain(self, item) -> bool:
        return bool(self.f.mightContain(item))

    def save(self, spark) -> bytes:
        out = spark._jvm.java.io.ByteArrayOutputStream()
        self.f.writeTo(out)
        return bytes(out.toByteArray())

    @classmethod
    def load(cls, spark, data: bytes) -> Bloom:
        return cls(spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(spark._jvm.java.io.ByteArrayInputStream(data)))


def probe(members: DataFrame, key: str, hashes: int = 4, bits: int = 1 << 20) -> tuple[DataFrame, F.Column]:
    """Set bits of a filter as a table (bit), and the bits of a key: a membership test that stays distributed."""
    of = lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(hashes)])
    return members.select(F.explode(of(F.col(key))).alias("bit")).distinct(), of(F.col(key))


def saturating(rows: DataFrame, bucket: F.Column) -> DataFrame:
    """Count of each bucket, at most TOP."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.least(F.count(F.lit(1)), F.lit(TOP)).cast("long").alias("estimate"))


#: Multipliers and summands of the rows of a count-min sketch, modulo a prime.
_PRIME = 2_147_483_647
_ROWS = ((48_271, 11), (69_621, 23), (16_807, 47), (39_373, 89))


def _buckets(key: Column, bits: int) -> Column:
    """One bucket of a non-negative long key in each row."""
    return F.array(*[F.pmod(F.pmod(key, F.lit(_PRIME)) * a + b, F.lit(_PRIME)).bitwiseAND(F.lit((1 << bits) - 1)) for a, b in _ROWS])


def count_min(rows: DataFrame, key: Column, bits: int = 10) -> DataFrame:
    """(row, bucket, n): a count-min sketch of long keys, with counters that saturate at TOP."""
    each = rows.select(F.posexplode(_buckets(key, bits)).alias("row", "bucket"))
    return each.groupBy("row", "bucket").agg(F.least(F.count(F.lit(1)), F.lit(TOP)).cast("long").alias("n"))


def count_min_estimate(keys: DataFrame, key: str, counters: DataFrame, bits: int = 10) -> DataFrame:
    """keys with `estimate`: the least of their counters; never under their number, but for saturation."""
    c = counters.select(F.col("row").alias("_row"), F.col("bucket").alias("_bucket"), "n")
    asked = keys.select(key).distinct().select(key, F.posexplode(_buckets(F.col(key), bits)).alias("row", "bucket"))
    got = asked.join(c, (F.col("row") == F.col("_row")) & (F.col("bucket") == F.col("_bucket")), "left")
    return got.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def halved(counters: DataFrame) -> DataFrame:
    """The sketch one aging later."""
    return counters.withColumn("n", F.shiftright("n", 1))


def false_positives(asked: DataFrame, key: str, bits: DataFrame, of: Column) -> DataFrame:
    """(asked, passed): how many keys, none of them members, the filter of probe() lets through."""
    each = asked.select(key, F.explode(of).alias("b")).join(bits, F.col("b") == F.col("bit"), "left")
    per = each.groupBy(key).agg(F.count_if(F.col("bit").isNull()).alias("missing"))
    return per.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("missing") == 0).alias("passed"))


def aged(rows: DataFrame, bucket: F.Column, epoch: F.Column, epochs: int) -> DataFrame:
    """Estimates after a number of epochs, at the end of each of which every counter is halved; counters saturate within them."""
    per = rows.groupBy(bucket.alias("bucket"), epoch.cast("int").alias("epoch")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    each = per.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "n"))).alias("m"))
    step = lambda acc, e: F.shiftright(F.least(acc + F.coalesce(F.element_at("m", e), F.lit(0)), F.lit(TOP).cast("long")), 1)
    return each.select("bucket", F.aggregate(F.sequence(F.lit(0), F.lit(epochs - 1)), F.lit(0).cast("long"), step).alias("estimate"))


def aged_by_time(rows: DataFrame, bucket: F.Column, ts: F.Column, until: F.Column, seconds: int = 60) -> DataFrame:
    """Estimates at a time, with all counters halved at the end of every window of so many seconds; empty windows halve too.

    Only windows with rows are folded; a gap is a shift by its length.
    """
    window = lambda t: F.floor(F.unix_timestamp(t) / seconds)
    per = rows.groupBy(bucket.alias("bucket"), window(ts).alias("w")).agg(F.count(F.lit(1)).cast("long").alias("n"), F.max(window(until)).alias("last"))
    each = per.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("w", "n"))).alias("ws"), F.max("last").alias("last"))
    # a counter holds four bits, so five shifts empty it
    down = lambda n, by: F.when(by > 4, F.lit(0).cast("long")).otherwise(F.floor(n / F.pow(F.lit(2), by)))
    start = F.struct(F.col("ws")[0]["w"].alias("w"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(x["w"].alias("w"), F.least(down(acc["n"], x["w"] - acc["w"]) + x["n"], F.lit(TOP).cast("long")).alias("n"))
    got = each.select("bucket", "last", F.aggregate("ws", start, step).alias("a"))
    return got.select("bucket", down(F.col("a.n"), F.col("last") - F.col("a.w")).cast("long").alias("estimate"))
