"""Latest-wins views over versioned key-value rows, and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .log import replica_get


def latest(rows: DataFrame, key: str = "k", value: str = "v", seq: str = "seq") -> DataFrame:
    """The value of each key's greatest seq; combined before the shuffle, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value))


def latest_ranked(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Whole latest rows. Spark limits each key's rows by rank before it shuffles them."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def point_get(rows: DataFrame, k, key: str = "k", value: str = "v", seq: str = "seq") -> DataFrame:
    """One row, or none; the key filter reaches the scan."""
    return latest(rows.filter(F.col(key) == k), key, value, seq)


def multi_get(keys: DataFrame, view: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Every requested key with its value; found tells a miss from any value."""
    v = view.select(F.col(key).alias("_k"), F.col(value), F.lit(True).alias("_hit"))
    got = keys.join(v, keys[key] == v["_k"], "left")
    return got.select(keys[key], value, F.coalesce("_hit", F.lit(False)).alias("found"))


def first_hit(rows: DataFrame, key: str, value: str, level: str, pos: str) -> DataFrame:
    """Each key's value in the lowest level, there in the newest segment."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(F.col(level), -F.col(pos))).alias(value), F.min(level).alias(level))


def delete_keys(live: DataFrame, gone: DataFrame, key: str = "k") -> DataFrame:
    """live without the keys of gone; keys that aren't there change nothing."""
    return live.join(gone.select(F.col(key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def without_deleted(log: DataFrame, key: str = "k", value: str = "v", seq: str = "seq", mode: str = "mode") -> DataFrame:
    """Latest rows of a log whose mode 1 deletes: a deletion hides all earlier versions."""
    last = log.groupBy(key).agg(F.max_by(F.struct(value, mode), seq).alias("_x"))
    return last.filter(F.col(f"_x.{mode}") == 0).select(key, F.col(f"_x.{value}").alias(value))


def commands(cmds: DataFrame, rows: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Answers to a batch of commands (seq, op, k, v): a get sees the table and the puts of the batch before it.

    An optget of commands that have a column idx reads from that node, and so
    sees the rows that the node has applied (node, applied_idx), and no puts of
    the batch.
    """
    puts = cmds.filter("op = 'put'").select("k", "v", F.col("seq").cast("long").alias("at"))
    base = rows.groupBy("k").agg(F.max_by("v", "seq").alias("v")).withColumn("at", F.lit(-1).cast("long"))
    ops = ["get", "sget"] if applied is not None else ["get", "sget", "optget"]
    reads = cmds.filter(F.col("op").isin(ops)).select("k", F.lit(None).cast("string").alias("v"), F.col("seq").cast("long").alias("at"))
    every = puts.withColumn("kind", F.lit(0)).unionByName(base.withColumn("kind", F.lit(0))).unionByName(reads.withColumn("kind", F.lit(1)))
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = every.withColumn("got", F.last(F.when(F.col("kind") == 0, F.col("v")), ignorenulls=True).over(w))
    out = seen.filter("kind = 1").select(F.col("at").alias("seq"), "k", F.col("got").alias("v"), F.col("got").isNotNull().alias("found"))
    if applied is None:
        return out
    asked = cmds.filter("op = 'optget'").select(F.col("seq").cast("long").alias("seq"), "k", F.col("idx").alias("node"))
    return out.unionByName(replica_get(asked, rows, applied, idx="seq").drop("node"))
