"""Cluster configuration: `n`, then n lines `id ip port` of peers, then the local `id ip port`, by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: F.Column) -> F.Column:
    """STRUCT<addresses: ARRAY<STRUCT<id, ip, port>>, local: STRUCT<id, ip, port>>."""
    t = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.element_at(t, 1).cast("int")
    one = lambda i: F.struct(
        F.get(t, 1 + i * 3).cast("int").alias("id"), F.get(t, 2 + i * 3).alias("ip"), F.get(t, 3 + i * 3).cast("int").alias("port")
    )
    peers = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<struct<id:int,ip:string,port:int>>"))
    return F.struct(peers.alias("addresses"), one(n).alias("local"))


def read(spark, path: str) -> DataFrame | None:
    """The configuration of a file, in one row (addresses, local); None where there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).select(parse(F.col("value")).alias("c")).select("c.*")
