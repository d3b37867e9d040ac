"""Sorted segments, the manifest over them, write buffers and compaction as table operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import ranged, with_last
from ..functions.tables import keep

#: Bytes above which level 0, 1, ... is merged into the next.
THRESHOLDS = (1024, 10 << 20, 100 << 20, 1000 << 20, 10_000 << 20)
#: Bytes of keys and values after which a write buffer is rotated: 3 MiB.
BUFFER_BYTES = 3_145_728
#: Below what any buffer holds.
_NONE = -(1 << 62)


def describe(rows: DataFrame, segment: str, key: str, *values: str) -> DataFrame:
    """First and last key, entries and bytes of each segment."""
    size = sum((F.octet_length(c).cast("long") for c in (key, *values)), F.lit(0).cast("long"))
    return rows.groupBy(segment).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")
    )


def locate(keys: DataFrame, manifest: DataFrame, key: str, segment: str) -> DataFrame:
    """keys with the segment whose first key is the last not above theirs; null before the first, and for a null key.

    Keys and first keys are ordered together over ranges; each key takes the
    last segment before it, whatever the number of either.
    """
    kind = manifest.schema[segment].dataType
    row = F.struct(*[keys[c] for c in keys.columns])
    ask = keys.select(F.col(key).alias("_key"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_seg"), row.alias("_row"))
    have = manifest.select(F.col("first_key").alias("_key"), F.lit(0).alias("_kind"), F.col(segment).alias("_seg"), F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"))
    got = with_last(ask.unionAll(have), ["_key", "_kind", "_seg"], "_seg", "_found").filter("_kind = 1")
    return got.select(*[F.col("_row")[c].alias(c) for c in keys.columns if c != segment], F.col("_found").alias(segment))


def overlaps(a: DataFrame, b: DataFrame, on: str = "sst_id") -> DataFrame:
    """Pairs of segments whose closed key ranges meet.

    The order of first keys is cut into as many cells as there are shuffle
    partitions; a segment goes to the cells that it reaches, and a pair is
    found in the one where the later of the two begins.
    """
    x = a.select(F.col(on).alias("left_id"), F.col("first_key").alias("lf"), F.col("last_key").alias("ll"))
    y = b.select(F.col(on).alias("right_id"), F.col("first_key").alias("rf"), F.col("last_key").alias("rl"))
    x, y = keep(x, "left"), keep(y, "right")
    starts = ranged(x.select(F.col("lf").alias("f")).unionAll(y.select("rf")).filter("f IS NOT NULL"), ["f"])
    # one bound for each partition
    bounds = F.array(*[F.lit(r.f) for r in starts.groupBy("_part").agg(F.min("f").alias("f")).collect()]).cast("array<string>")
    cell = lambda c: F.size(F.filter(bounds, lambda f: f <= F.col(c)))
    x = x.withColumn("_cell", F.explode(F.sequence(cell("lf"), cell("ll"))))
    y = y.withColumn("_cell", F.explode(F.sequence(cell("rf"), cell("rl")))).withColumn("_begin", cell("rf"))
    meet = (F.col("ll") >= F.col("rf")) & (F.col("lf") <= F.col("rl"))
    got = x.withColumn("_first", cell("lf")).join(y.withColumnRenamed("_cell", "_c"), (F.col("_cell") == F.col("_c")) & meet)
    return got.filter(F.col("_cell") == F.greatest("_first", "_begin")).select("left_id", "right_id")


def merge(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Newest-wins union; sources in order from the newest. No sort: a least-rank aggregate is combined before the shuffle."""
    every = None
    for rank, s in enumerate(sources):
        s = s.select(key, value, F.lit(rank).alias("_rank"))
        every = s if every is None else every.unionAll(s)
    return every.groupBy(key).agg(F.min_by(value, "_rank").alias(value))


def splice(manifest: DataFrame, merged_ids: list[int], new: DataFrame, level: int) -> DataFrame:
    """The manifest after a compaction: merged segments leave, the new one joins `level`, whose places follow first keys."""
    rest = manifest.filter(~F.col("sst_id").isin(merged_ids))
    every = rest.select("level", "sst_id", "first_key", "last_key").unionByName(new.withColumn("level", F.lit(level)).select("level", "sst_id", "first_key", "last_key"))
    w = Window.partitionBy("level").orderBy("first_key", "sst_id")
    return every.withColumn("pos", F.row_number().over(w).cast("long"))


def due(manifest: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Bytes of each level, and whether they pass its threshold."""
    limit = F.element_at(F.array(*[F.lit(int(t)) for t in thresholds]), F.col("level") + 1).cast("long")
    per = manifest.groupBy("level").agg(F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("full", F.coalesce(F.when(F.col("level") < len(thresholds), F.col("bytes") > limit), F.lit(False)))


def hits(answers: DataFrame, found: str = "found") -> DataFrame:
    """Number of look-ups, and of those that found something."""
    return answers.agg(F.count(F.lit(1)).alias("asked"), F.count_if(found).alias("hits"))


# -- write buffers -----------------------------------------------------------------


def _turns(limit: int):
    """Over one range of rows: what a buffer that comes in with some bytes leads to.

    Rows (part, after, turns, left): a buffer of more than `after` bytes, and
    not more than the row before says, turns over so often in the range and
    leaves it with `left` bytes in the last buffer.  The last row says by how
    much a buffer grows that doesn't turn over.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, size = int(pdf["_part"].iloc[0]), pdf.sort_values("_seq")["_size"].to_numpy(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        m = len(size)
        nxt = np.searchsorted(upto, upto + limit, side="right")
        turns, left = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for i in range(m - 1, -1, -1):
            q = nxt[i]
            turns[i], left[i] = (turns[q] + 1, left[q]) if q <= m else (0, upto[m] - upto[i])
        # the first row that can be the last of a buffer is reached with the fullest one, and so on down to an empty one
        q = np.arange(1, min(m, int(np.searchsorted(upto, limit, side="right"))) + 1)
        out = pd.DataFrame({"part": part, "after": limit - upto[q], "turns": turns[q] + 1, "left": left[q]})
        return pd.concat([out, pd.DataFrame({"part": [part], "after": [_NONE], "turns": [0], "left": [upto[m]]})])

    return run


def _enter(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows of _turns by part and falling `after`: the buffer's number and bytes with which each range begins."""
    number = carry = 0
    part, state = None, None
    for pdf in pdfs:
        out = []
        for p, after, turns, left in zip(pdf["part"], pdf["after"], pdf["turns"], pdf["left"], strict=True):
            if p != part:
                number, carry = state or (0, 0)
                out.append((p, number, carry))
                part, state = p, None
            if state is None and after == _NONE:
                state = number, carry + left
            elif state is None and carry > after:
                state = number + turns, left
        yield pd.DataFrame(out, columns=["_p", "_number", "_carry"])


def _assign(limit: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = None, 0, 0
        for pdf in pdfs:
            size, parts = pdf["_size"].to_numpy(np.int64), pdf["_part"].to_numpy()
            out = np.empty(len(size), np.int64)
            at = 0
            while at < len(size):
                if parts[at] != part:
                    part, number, held = parts[at], int(pdf["_number"].iloc[at]), int(pdf["_carry"].iloc[at])
                end = at + int(np.searchsorted(parts[at:], part, side="right"))
                upto = np.cumsum(size[at:end])
                q = int(np.searchsorted(upto, limit - held, side="right"))
                if q < end - at:
                    out[at : at + q + 1] = number
                    at, number, held = at + q + 1, number + 1, 0
                else:
                    out[at:end] = number
                    at, held = end, held + int(upto[-1])
            yield pdf.drop(columns=["_part", "_size", "_number", "_carry"]).assign(buffer=out)

    return run


def rotate(rows: DataFrame, seq: str, size: F.Column, limit: int = BUFFER_BYTES) -> DataFrame:
    """rows with `buffer`: the number of the write buffer that each goes to, in order of seq, which should have no ties.

    A buffer is left as soon as it holds more than `limit` bytes, with the row
    that made it so.  Where a buffer begins depends on all rows before it, but
    a range of rows can be summed up by what it does to a buffer that comes in;
    one task goes over these sums, and each range then deals its own rows.
    """
    plain = rows.columns
    r = ranged(rows.withColumn("_seq", F.col(seq)).withColumn("_size", size.cast("long")), ["_seq"])
    turns = r.select("_part", "_seq", "_size").groupBy("_part").applyInPandas(_turns(limit), "part int, after long, turns long, left long")
    # entering is a pass over rows as many as those that a buffer's bytes hold, for each range
    first = turns.repartition(1).sortWithinPartitions("part", F.desc("after")).mapInPandas(_enter, "_p int, _number long, _carry long")
    got = r.join(F.broadcast(keep(first, "entries")), F.col("_part") == F.col("_p")).select(*plain, "_part", "_seq", "_size", "_number", "_carry")
    got = got.repartition("_part").sortWithinPartitions("_part", "_seq").drop("_seq")
    return got.mapInPandas(_assign(limit), T.StructType([*rows.schema.fields, T.StructField("buffer", T.LongType())]))
