"""One object for a session's configuration, log and store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.order import with_position
from .sources import config
from .sources.journal import Journal
from .sources.store import Store


class Engine:
    """put and delete go to the log; commit lets them through to the store, from which get and view read."""

    def __init__(self, spark: SparkSession, base: str, config_path: str | None = None):
        self.spark = spark
        self.config = config.read(spark, config_path) if config_path else None
        self.store = Store(spark, base)
        self.journal = Journal(spark, f"{base.rstrip('/')}/journal")

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def put(self, rows: DataFrame, by: list | None = None) -> tuple[int, int]:
        """Append rows (k, v[, mode]) under the next indexes, in order of `by`; the first and the last of them."""
        last = self.journal.last()
        rows = with_position(rows, by or ["k"], "_n").withColumn("seq", F.col("_n") + last)
        have = self.journal.entries().filter("run = 'main'").agg(F.max("batch")).first()[0]
        self.journal.append(rows, 0 if have is None else have + 1)
        return last + 1, self.journal.last()

    def delete(self, keys: DataFrame) -> tuple[int, int]:
        return self.put(keys.select("k", F.lit(None).cast("string").alias("v"), F.lit(1).alias("mode")))

    def commit(self, index: int | None = None) -> int:
        """Commit up to an index, or all, and apply; the commit index."""
        self.journal.advance(index)
        return self.journal.apply(self.store)

    def get(self, k: str) -> str | None:
        return self.store.get(k)

    def view(self) -> DataFrame:
        return self.store.view()

    def close(self) -> None:
        """Commit and flush what is still in the log, and delete what nothing needs."""
        self.commit()
        self.store.vacuum()
        self.journal.vacuum()
