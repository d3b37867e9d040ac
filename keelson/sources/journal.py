"""The log beside a store: entries are kept from the moment they arrive, and reach the store once they are committed.

Layout of base: entries/run=<name>/batch=<n>/ and state/<version>/, one row with
the commit index, the index up to which entries have been applied, and for each
run the last batch that was there then.  Applying again changes nothing, as the
store keeps the latest seq of each key, so a crash between a flush and the note
of it does no harm.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, Versions

_ENTRY = "k string, v string, seq long, mode int, run string, batch long"
_STATE = "commited long, applied long, batches string"


class Journal:
    """append, advance, apply; mode 1 deletes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.states = Versions(spark, f"{self.base}/state")

    def append(self, rows: DataFrame, batch: int, run: str = "main") -> None:
        """Keep entries (k, v, seq[, mode]) as a batch of a run; the same batch again replaces itself."""
        mode = F.col("mode").cast("int") if "mode" in rows.columns else F.lit(0)
        rows.select("k", "v", F.col("seq").cast("long").alias("seq"), mode.alias("mode")).write.mode("overwrite").parquet(
            f"{self.base}/entries/run={run}/batch={batch}"
        )

    def entries(self) -> DataFrame:
        fs, p = self.states.path("..", "entries")
        if not fs.exists(p):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.base}/entries")

    def state(self) -> tuple[int, int, dict]:
        """Commit index, applied index, and the last batch of each run when that was applied."""
        rows = self.states.read(_STATE)
        return (rows[0].commited, rows[0].applied, json.loads(rows[0].batches)) if rows else (0, 0, {})

    def _note(self, commited: int, applied: int, batches: dict) -> None:
        row = self.spark.createDataFrame([(commited, applied, json.dumps(batches))], _STATE)
        self.states.write(row, self.states.current() + 1)
        self.states.trim()

    def last(self) -> int:
        """The last index, 0 for an empty log."""
        return self.entries().agg(F.max("seq")).first()[0] or 0

    def advance(self, leader_commit: int | None = None) -> int:
        """Take the commit index to the leader's, or to the end of the log, but never back or past the end; it is kept."""
        commited, applied, batches = self.state()
        last = self.last()
        new = max(commited, last if leader_commit is None else min(last, leader_commit))
        if new != commited:
            self._note(new, applied, batches)
        return new

    def pending(self) -> DataFrame:
        """Committed entries that haven't been applied, also those that came late."""
        commited, applied, batches = self.state()
        seen = F.lit(False)
        for run, batch in batches.items():
            seen = seen | ((F.col("run") == run) & (F.col("batch") <= batch))
        return self.entries().filter((F.col("seq") <= commited) & ~(seen & (F.col("seq") <= applied)))

    def apply(self, store: Store) -> int:
        """Flush pending entries into the store, and compact it; the applied index."""
        commited = self.state()[0]
        batches = {r.run: r.batch for r in self.entries().groupBy("run").agg(F.max("batch").alias("batch")).collect()}
        rows = self.pending()
        if not rows.isEmpty():
            store.flush(rows.filter("mode = 1 OR v IS NOT NULL").select("k", F.when(F.col("mode") == 0, F.col("v")).alias("v"), "seq"))
            store.compact()
        self._note(commited, commited, batches)
        return commited

    def vacuum(self) -> int:
        """Delete batches whose entries have all been applied, but the last of each run; their number."""
        _, applied, batches = self.state()
        per = self.entries().groupBy("run", "batch").agg(F.max("seq").alias("top")).filter(F.col("top") <= applied).collect()
        gone = [r for r in per if r.batch < batches.get(r.run, -1)]
        for r in gone:
            fs, p = self.states.path("..", "entries", f"run={r.run}", f"batch={r.batch}")
            fs.delete(p, True)
        return len(gone)
