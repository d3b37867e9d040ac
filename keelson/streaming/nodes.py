"""Nodes of a cluster as keyed state of a stream: what each has appended, and when it was last heard of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.log import Follower


def solve_appends(requests: DataFrame) -> DataFrame:
    """(node, seq, code, term, last_idx, commit_idx) of requests (node, seq, leader, term, commited, first_idx, n), as they come.

    The streaming form of operators.log.solve_appends: a node's rows are taken
    in order of seq within a micro-batch, and its state outlives it.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Follower()
        if state.exists:
            f.term, f.last, f.commit, f.leader = state.get
        rows = pd.concat(list(pdfs)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            code = f.solve(r.leader, r.term, r.commited, None if pd.isna(r.first_idx) else int(r.first_idx), r.n)
            out.append((key[0], r.seq, code, f.term, f.last, f.commit))
        state.update((int(f.term), int(f.last), int(f.commit), None if f.leader is None else int(f.leader)))
        yield pd.DataFrame(out, columns=["node", "seq", "code", "term", "last_idx", "commit_idx"])

    return requests.groupBy("node").applyInPandasWithState(
        step, "node long, seq long, code int, term long, last_idx long, commit_idx long", "term long, last long, commit long, leader long", "append", GroupStateTimeout.NoTimeout
    )


def timeouts(beats: DataFrame, seconds: int = 5, late: str = "0 seconds") -> DataFrame:
    """(node, last_seen): nodes of beats (node, ts) that weren't heard of for so many seconds of event time.

    A node is told of once for each silence, when the watermark has passed its
    end; beats that are late by more than `late` may be dropped.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"node": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else None
        seen = sorted(int(t.value // 1000) for pdf in pdfs for t in pdf["ts"])
        for t in seen:
            if last is not None and t > last + seconds * 1_000_000:
                yield pd.DataFrame({"node": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = beats.select("node", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("node").applyInPandasWithState(step, "node long, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def collect_appended(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is available, adding results to the Parquet table of a path."""
    out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
