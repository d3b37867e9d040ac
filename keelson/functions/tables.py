"""Intermediate tables in the folder that the driver and all executors share.

The folder comes from spark.checkpoint.dir.  Only a local session (tests) that
leaves it unset gets a temporary one; on a cluster executors don't see one
another's disks, so there it must be set.  Written tables cut the lineage, so
that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written since each open scratch() began, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = have.get() if have.isDefined() else None
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="keelson-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, at: str) -> DataFrame:
    """df as a table written at a path; its shuffles' files go as soon as it is written."""
    spark, schema = df.sparkSession, df.schema
    was = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_FREE, was) if was is not None else spark.conf.unset(_FREE)
    return spark.read.schema(schema).parquet(at)


def keep(df: DataFrame, name: str = "part", last: bool = False) -> DataFrame:
    """df as a table written once in the shared folder.

    In a scratch() the table goes when that ends; if `last`, when the one around it does.
    """
    at = fresh(df.sparkSession, name)
    if len(_open) > last:
        _open[-1 - last].append(at)
    return put(df, at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that keep() has written in it."""
    _open.append([])
    try:
        yield
    finally:
        for at in _open.pop():
            drop(spark, at)


def drop(spark: SparkSession, at: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
