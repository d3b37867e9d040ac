"""The log as a stream: latest-wins state, and flushing of committed entries into a store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import drop, fresh
from ..sources.journal import Journal


def log_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_stream(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Running latest values. No watermark: a late row of lower seq loses by comparison, it isn't dropped."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def run_to_table(out: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Process all that is available, and give the whole result as a written table; each batch's replaces the one before."""
    spark = out.sparkSession
    at, done = fresh(spark, "stream"), []

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/{n}")
        for old in done:
            drop(spark, f"{at}/{old}")
        done[:] = [n]

    w = out.writeStream.outputMode("complete").trigger(availableNow=True)
    w.option("checkpointLocation", checkpoint or fresh(spark, "offsets")).foreachBatch(batch).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/{done[0]}") if done else spark.createDataFrame([], out.schema)


def flush_to_store(log: DataFrame, store, checkpoint: str, commit: int | None = None):
    """Every micro-batch goes to the store's journal; what is committed of it becomes a segment, and compaction follows where levels are full.

    Entries above the commit index stay in the journal, which also keeps that
    index, until a call with a greater one, or with none, which commits all.
    """
    journal = Journal(store.spark, f"{store.base}/journal")
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, n: int) -> None:
        journal.append(df, n, run)
        journal.advance(commit)
        journal.apply(store)

    journal.advance(commit)
    journal.apply(store)
    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
