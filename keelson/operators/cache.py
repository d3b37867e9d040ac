"""Recency caches over access traces: closed forms where they exist, folds per shard elsewhere."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import parts

SHARDS, PROMOTE = 64, 8


def top_recent(trace: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """Content of a strict LRU cache after a trace: the keys of latest access."""
    return trace.groupBy(key).agg(F.max(seq).alias("last_seq")).orderBy(F.desc("last_seq")).limit(capacity)


def top_recent_sharded(trace: DataFrame, key: str, seq: str, shard: F.Column, capacity: int) -> DataFrame:
    per = trace.groupBy(key).agg(F.max(seq).alias("last_seq")).withColumn("shard", shard)
    w = Window.partitionBy("shard").orderBy(F.desc("last_seq"))
    return per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= capacity).drop("_r")


def peek(keys: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """keys with `held`: whether the cache has them; nothing is promoted."""
    have = content.select(F.col(key).alias("_have")).distinct()
    return keys.join(have, F.col(key) == F.col("_have"), "left").withColumn("held", F.col("_have").isNotNull()).drop("_have")


def sizes(content: DataFrame, capacity: int) -> DataFrame:
    """Number of keys in each shard, and whether it is full."""
    return content.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).withColumn("full", F.col("size") >= capacity)


def shard_capacity(capacity: int, shards: int = SHARDS) -> int:
    """A sharded cache's capacity for each shard: a share and one more."""
    return capacity // shards + 1


class Lru:
    """Bounded recency list: a key moves to the front on every promote-th touch, counted from its last move."""

    def __init__(self, capacity: int, promote: int = PROMOTE):
        self.capacity, self.promote = capacity, promote
        self.data: OrderedDict = OrderedDict()  # back of the list first

    def _touch(self, k) -> None:
        value, n = self.data[k]
        if n >= self.promote:
            self.data[k] = (value, 0)
            self.data.move_to_end(k)
        else:
            self.data[k] = (value, n + 1)

    def get(self, k):
        if k not in self.data:
            return None
        self._touch(k)
        return self.data[k][0]

    def peek(self, k):
        return self.data[k][0] if k in self.data else None

    def put(self, k, v, admit: Callable | None = None):
        """The key that had to leave: the oldest, or k itself if admit(oldest, k) says no; None if there was room. A known key keeps its value."""
        if k in self.data:
            self._touch(k)
            return None
        out = None
        if len(self.data) >= self.capacity:
            oldest = next(iter(self.data))
            if admit is not None and not admit(oldest, k):
                return k
            del self.data[oldest]
            out = oldest
        self.data[k] = (v, 0)
        return out

    def access(self, k) -> tuple:
        """Whether k was there, and the key that had to leave for it, if any."""
        if self.get(k) is not None:
            return True, None
        return False, self.put(k, k)

    def halve(self) -> None:
        """No frequencies here."""


class Frequency:
    """Exact per-key counts that saturate at 15 and can be halved."""

    def __init__(self):
        self.n: dict = {}

    def add(self, k) -> None:
        self.n[k] = min(15, self.n.get(k, 0) + 1)

    def get(self, k) -> int:
        return self.n.get(k, 0)

    def halve(self) -> None:
        self.n = {k: v >> 1 for k, v in self.n.items() if v > 1}


class TinyLfu:
    """A window of a hundredth of the capacity before a main part; a window's victim enters the full main part only if it is more frequent than the oldest there."""

    def __init__(self, capacity: int, promote: int = 0):
        self.window, self.main = Lru(max(1, capacity // 100), promote), Lru(max(1, capacity - capacity // 100), promote)
        self.freq = Frequency()

    def access(self, k) -> tuple:
        """Whether k was there, and the key that had to leave both parts, if any."""
        self.freq.add(k)
        if self.window.get(k) is not None or self.main.get(k) is not None:
            return True, None
        victim = self.window.put(k, k)
        if victim is not None:
            return False, self.main.put(victim, victim, lambda old, new: self.freq.get(old) < self.freq.get(new))
        return False, None

    def peek(self, k):
        got = self.window.peek(k)
        return self.main.peek(k) if got is None else got

    def halve(self) -> None:
        self.freq.halve()


def replay(trace: DataFrame, make: Callable, seq: str = "seq", key: str = "k", shard: Column | None = None, period: int | None = None) -> DataFrame:
    """(shard, seq, k, hit, victim): each access of a cache per shard, which `make()` builds, in order of seq.

    victim is the key that left the cache, which is the accessed one's
    neighbour in the window where that was not admitted.  A fold can't be
    combined, so a shard is one task's work however hot it is: it is streamed
    in order, and its state is bounded by the cache's capacity.  period:
    accesses of a shard after which frequencies are halved.
    """
    kind = trace.schema[key].dataType.simpleString()

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, n = None, None, 0
        for pdf in pdfs:
            out = []
            for s, at, k in zip(pdf["shard"], pdf["seq"], pdf["k"], strict=True):
                if s != now:
                    state, now, n = make(), s, 0
                out.append((s, at, k, *state.access(k)))
                n += 1
                if period and n % period == 0:
                    state.halve()
            got = pd.DataFrame(out, columns=["shard", "seq", "k", "hit", "victim"])
            yield got.assign(victim=got["victim"].astype("Int64" if kind in ("bigint", "int") else "object"))

    place = F.pmod(F.xxhash64(key), F.lit(SHARDS)) if shard is None else shard
    rows = trace.select(place.cast("long").alias("shard"), F.col(seq).alias("seq"), F.col(key).alias("k"))
    ordered = rows.repartition(max(SHARDS, parts(trace.sparkSession)), "shard").sortWithinPartitions("shard", "seq")
    return ordered.mapInPandas(run, f"shard long, seq {trace.schema[seq].dataType.simpleString()}, k {kind}, hit boolean, victim {kind}")


def simulate(trace: DataFrame, make: Callable, seq: str = "seq", key: str = "k", shard: Column | None = None, period: int | None = None) -> DataFrame:
    """(shard, hits, misses, evictions) of a replay()."""
    each = replay(trace, make, seq, key, shard, period)
    return each.groupBy("shard").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("victim").alias("evictions"))
