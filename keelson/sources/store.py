"""Segments as sorted Parquet with Bloom filters on the key, under a versioned manifest.

Layout of base: segments/<id>/ and manifest/<version>/; the current version is
the greatest whose directory Spark has marked complete.  One writer at a time;
of two that commit the same version one fails.  A deleted key is a row without
a value, which hides older ones until a compaction has merged all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.order import byte_size
from ..operators import segments
from ..schemas import MANIFEST, SEGMENT


class Versions:
    """A folder of numbered tables, the greatest complete one being current."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, *name):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *map(str, name)]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        """From the greatest."""
        fs, p = self.path()
        return sorted((int(s.getPath().getName()) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []

    def current(self) -> int:
        for v in self.numbers():
            fs, p = self.path(v, "_SUCCESS")
            if fs.exists(p):
                return v
        return 0

    def read(self, schema) -> list:
        v = self.current()
        return self.spark.read.schema(schema).parquet(f"{self.base}/{v}").collect() if v else []

    def write(self, df: DataFrame, version: int) -> None:
        """Fails if that version is there; what a writer that died has left of it goes first."""
        fs, p = self.path(version)
        if fs.exists(p) and not fs.exists(self.path(version, "_SUCCESS")[1]):
            fs.delete(p, True)
        df.coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/{version}")

    def trim(self) -> list[int]:
        """Delete all versions before the current one; their numbers."""
        gone = [v for v in self.numbers() if v < self.current()]
        for v in gone:
            fs, p = self.path(v)
            fs.delete(p, True)
        return gone


class Store:
    """Versioned key-value table: put_batch, delete_batch, get, multi_get, scan, compact, vacuum."""

    def __init__(self, spark: SparkSession, base: str, thresholds=segments.THRESHOLDS, rows_per_file: int = 5_000_000):
        self.spark, self.base, self.thresholds, self.rows_per_file = spark, base.rstrip("/"), thresholds, rows_per_file
        self.versions = Versions(spark, f"{self.base}/manifest")

    # -- files ---------------------------------------------------------------

    def version(self) -> int:
        return self.versions.current()

    def manifest(self) -> list:
        """Rows of the current manifest; one per segment, so small beside the data."""
        return self.versions.read(MANIFEST)

    def _commit(self, rows: list[tuple]) -> None:
        v = self.version() + 1
        self.versions.write(self.spark.createDataFrame([(v, *r) for r in rows], MANIFEST), v)

    def _write(self, rows: DataFrame, sst_id: int) -> tuple:
        """A segment sorted by key; (first_key, last_key, n, bytes), counted as it is written."""
        path, seen = f"{self.base}/segments/{sst_id}", Observation()
        w = rows.select("k", "v", "seq").repartitionByRange("k").sortWithinPartitions("k")
        w = w.observe(seen, F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"), F.sum(byte_size("k", "v")).alias("bytes"))
        w = w.write.mode("overwrite").option("parquet.bloom.filter.enabled#k", "true").option("maxRecordsPerFile", self.rows_per_file)
        w.parquet(path)
        r = seen.get
        return r["first"], r["last"], r["n"], r["bytes"] or 0

    def _read(self, ids: list[int]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).parquet(*[f"{self.base}/segments/{i}" for i in ids])

    # -- writes --------------------------------------------------------------

    def put_batch(self, rows: DataFrame) -> int:
        """Flush rows (k, v, seq), latest of each key, as a new newest segment of level 0; its id. Rows without key or value are left out."""
        return self.flush(rows.filter("v IS NOT NULL"))

    def delete_batch(self, rows: DataFrame) -> int:
        """Flush rows (k, seq) that delete their keys; a key that isn't there is no error, and one put later, by seq, is there again."""
        return self.flush(rows.select("k", F.lit(None).cast("string").alias("v"), "seq"))

    def flush(self, rows: DataFrame) -> int:
        """put_batch and delete_batch in one: a row without a value deletes."""
        rows = rows.filter("k IS NOT NULL").groupBy("k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
        have = self.manifest()
        sst = max((r.sst_id for r in have), default=0) + 1
        new = self._write(rows, sst)
        pos = max((r.pos for r in have if r.level == 0), default=0) + 1
        old = [(r.level, r.pos, r.sst_id, r.first_key, r.last_key, r.n, r.bytes) for r in have]
        self._commit([*old, (0, pos, sst, *new)])
        return sst

    def compact(self) -> int:
        """Merge levels that are over their thresholds into the next, each with a fresh id; the number of merges."""
        done = 0
        for level, limit in enumerate(self.thresholds):
            have = self.manifest()
            mine = [r for r in have if r.level == level and r.n]
            if sum(r.bytes for r in mine) <= limit:
                break
            lo, hi = min(r.first_key for r in mine), max(r.last_key for r in mine)
            meets = lambda r, lo=lo, hi=hi: r.n and r.last_key >= lo and r.first_key <= hi
            met = [r for r in have if r.level == level + 1 and meets(r)]
            gone = {r.sst_id for r in [*mine, *met]}
            sst = max(r.sst_id for r in have) + 1
            merged = self._read(sorted(gone)).groupBy("k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
            if not any(r.level > level + 1 and meets(r) for r in have):
                merged = merged.filter("v IS NOT NULL")  # nothing older is left to hide
            first, last, n, size = self._write(merged, sst)
            rest = [r for r in have if r.sst_id not in gone and not (r.level == level and not r.n)]
            below = [(r.first_key, r.last_key, r.sst_id, r.n, r.bytes) for r in rest if r.level == level + 1]
            below = sorted([*below, *([(first, last, sst, n, size)] if n else [])])
            keep = [(r.level, r.pos, r.sst_id, r.first_key, r.last_key, r.n, r.bytes) for r in rest if r.level != level + 1]
            self._commit(keep + [(level + 1, i + 1, s, f, la, c, b) for i, (f, la, s, c, b) in enumerate(below)])
            done += 1
        return done

    def vacuum(self) -> list[int]:
        """Delete segments that the current manifest doesn't name, and older manifests; the segments' ids."""
        live = {r.sst_id for r in self.manifest()}
        every = Versions(self.spark, f"{self.base}/segments")
        gone = sorted(i for i in every.numbers() if i not in live)
        for i in gone:
            fs, p = every.path(i)
            fs.delete(p, True)
        self.versions.trim()
        return gone

    # -- reads ---------------------------------------------------------------

    def _covering(self, lo: str | None, hi: str | None) -> list[int]:
        return [r.sst_id for r in self.manifest() if r.n and (lo is None or r.last_key >= lo) and (hi is None or r.first_key <= hi)]

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k").agg(F.max_by("v", "seq").alias("v")).filter("v IS NOT NULL")

    def view(self) -> DataFrame:
        return self._live(self._read(self._covering(None, None)))

    def get(self, k: str) -> str | None:
        """Only segments whose range has the key are opened, and the key filter reaches their footers."""
        r = self._read(self._covering(k, k)).filter(F.col("k") == k).agg(F.max_by("v", "seq")).first()
        return r[0]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        v = self.view()
        return keys.join(v.withColumnRenamed("k", "_k"), F.col("k") == F.col("_k"), "left").select("k", "v", F.col("_k").isNotNull().alias("found"))

    def scan(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        rows = self._read(self._covering(lo, hi))
        if lo is not None:
            rows = rows.filter(F.col("k") >= lo)
        if hi is not None:
            rows = rows.filter(F.col("k") <= hi)
        return self._live(rows).orderBy("k")
