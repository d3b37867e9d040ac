"""The replicated log as a table: replay, gates, checks; and its decisions as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_max, with_position, with_rank
from ..functions.tables import keep

#: Entries that the bounded log holds.
RING = 262_144
#: Answers to requests: done, failed, ask the leader (a read or write) or wrong index (an append), more than one entry.
OK, FAILED, ELSEWHERE, WRONG_INDEX, UNSUPPORTED = 0, -1, -2, -2, -3


def replay(log: DataFrame, commit, idx: str, key: str, value: str) -> DataFrame:
    """Latest values of the entries up to the commit index; the filter reaches the scan."""
    return log.filter(F.col(idx) <= commit).groupBy(key).agg(F.max_by(value, idx).alias(value))


def truncate(log: DataFrame, upto, idx: str) -> DataFrame:
    return log.filter(F.col(idx) <= upto)


def retain(log: DataFrame, idx: str, ring: int = RING) -> DataFrame:
    """The last `ring` indexes: one aggregated row, broadcast, then a filter. No sort."""
    top = log.agg(F.max(idx).alias("_top"))
    return log.join(F.broadcast(top), F.col(idx) > F.col("_top") - ring).drop("_top")


def contiguity(log: DataFrame, idx: str) -> DataFrame:
    """(idx, ok): whether the entry before is there, or it is the first; an equi-join, so no single ordered task."""
    before = log.select((F.col(idx) + 1).alias("_next")).distinct()
    least = log.agg(F.min(idx).alias("_least"))
    got = log.select(idx).join(before, F.col(idx) == F.col("_next"), "left").join(F.broadcast(least))
    return got.select(idx, (F.col("_next").isNotNull() | (F.col(idx) == F.col("_least"))).alias("ok"))


def advance(commit: F.Column, last: F.Column, leader: F.Column) -> F.Column:
    """Commit index after hearing the leader's."""
    return F.greatest(commit, F.least(last, leader))


def append(log: DataFrame, entries: DataFrame, term, by: list, idx: str = "idx", ring: int = RING) -> DataFrame:
    """The leader's append: entries with their term, mode 0 and the indexes after the log's last, in the order of `by`.

    Entries that the bounded log has no room for are left out.
    """
    have = log.agg(F.coalesce(F.max(idx), F.lit(0)).alias("_last"), F.count(F.lit(1)).alias("_held"))
    got = with_position(entries, by, "_nth").join(F.broadcast(have)).filter(F.col("_nth") + F.col("_held") <= ring)
    got = got.withColumn(idx, (F.col("_last") + F.col("_nth")).cast("long")).withColumn("term", F.lit(term).cast("long"))
    return got.withColumn("mode", F.lit(0)).drop("_nth", "_last", "_held")


def receive(entries: DataFrame, commited: str, idx: str = "idx", start: int = 0) -> DataFrame:
    """The follower's append: entries with the commit index after each, which is the largest that any entry so far has brought."""
    return with_max(entries, [idx], commited, "_most").withColumn("commit_idx", F.greatest(F.lit(start).cast("long"), "_most")).drop("_most")


def at(log: DataFrame, n, idx: str = "idx") -> DataFrame:
    """The entry of an index; the filter reaches the scan."""
    return log.filter(F.col(idx) == n)


def progress(answers: DataFrame, node: str, seq: str, done: str, start: int = 0) -> DataFrame:
    """The replication loop as a table: each follower's matched index after each answer; one more if it was done, one less if not."""
    step = F.when(F.col(done), 1).otherwise(-1)
    w = Window.partitionBy(node).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return answers.select(node, seq, done, (F.lit(start) + F.sum(step).over(w)).cast("long").alias("match_idx"))


def commit_index(acks: DataFrame, group: str, node: str, match: str) -> DataFrame:
    """The index that a majority of a group's nodes has: the (n div 2 + 1)-th largest of their last ones.

    Nodes are ranked over ranges of (group, index), so no task holds a group.
    """
    last = acks.groupBy(group, node).agg(F.max(match).alias("m"))
    ranked = keep(with_rank(last, [group], [F.desc("m"), node]), "ranked")
    n = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("nodes")).withColumnRenamed(group, "_g")
    got = ranked.join(n, F.col(group).eqNullSafe(F.col("_g"))).filter(F.col("rank") == F.floor(F.col("nodes") / 2) + 1)
    return got.select(group, "nodes", F.col("m").alias("commit_idx"))


def barrier(entries: DataFrame, acks: DataFrame, group: str, node: str, match: str, idx: str = "idx") -> DataFrame:
    """entries with `done`: whether a majority of their group's nodes has them, so that the write may return."""
    c = commit_index(acks, group, node, match).select(F.col(group).alias("_g"), "commit_idx")
    got = entries.join(c, F.col(group).eqNullSafe(F.col("_g")), "left")
    return got.withColumn("done", F.coalesce(F.col(idx) <= F.col("commit_idx"), F.lit(False))).drop("_g", "commit_idx")


def elections(votes: DataFrame, term: str, granted: str) -> DataFrame:
    """Votes of each term, and whether more than half were granted."""
    per = votes.groupBy(term).agg(F.count(F.lit(1)).alias("votes"), F.count_if(granted).alias("granted"))
    return per.withColumn("elected", F.col("granted") * 2 > F.col("votes"))


def grant(term, last, voted, my_term, my_last) -> F.Column:
    """Vote rule: no lower term, no second vote in a term, no log shorter than ours."""
    return (term > my_term) & (last >= my_last) | (term == my_term) & voted.isNull() & (last >= my_last)


def gaps(beats: DataFrame, node: str, ts: str, seconds: int) -> DataFrame:
    """Beats that came more than `seconds` after their node's last."""
    before = F.lag(ts).over(Window.partitionBy(node).orderBy(ts))
    return beats.select(node, ts, before.alias("last_seen")).filter(F.col(ts) > F.col("last_seen") + F.expr(f"INTERVAL '{seconds}' SECOND"))


def redirect(requests: DataFrame, addresses: DataFrame, leader: F.Column, is_leader: F.Column) -> DataFrame:
    """requests with code 0 on the leader, -2 and its address elsewhere, -1 if it is unknown."""
    a = addresses.select(F.col("id").alias("_aid"), F.col("address").alias("leader_address"))
    got = requests.withColumn("_leader", leader).withColumn("_is", is_leader).join(a, F.col("_leader") == F.col("_aid"), "left")
    code = F.when(F.col("_is"), 0).when(F.col("leader_address").isNull(), -1).otherwise(-2)
    return got.withColumn("code", code).withColumn("leader_address", F.when(F.col("code") == -2, F.col("leader_address"))).drop("_leader", "_is", "_aid")


def heartbeats(leaders: DataFrame, followers: DataFrame, start: str, stop: str, millis: int = 1000) -> DataFrame:
    """The empty appends that leaders (leader, term, commit_idx) send to followers (leader, follower) every so often."""
    ticks = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"INTERVAL '{millis / 1000:.3f}' SECOND"))
    l = leaders.select(F.col("leader").alias("_l"), "term", "commit_idx")  # noqa: E741
    return followers.join(l, F.col("leader") == F.col("_l")).select("leader", "follower", F.explode(ticks).alias("ts"), "term", "commit_idx")


class Follower:
    """What a node does with appends: its term, last index and commit index."""

    def __init__(self):
        self.term = self.last = self.commit = 0
        self.leader = None

    def solve(self, leader, term: int, commit: int, first: int | None, n: int) -> int:
        """The answer to an append of n entries, the first with index `first`, from a leader of some term and commit index."""
        if term > self.term or (term == self.term and n and first > self.last):
            self.term, self.leader = term, leader
        self.commit = max(self.commit, min(self.last, commit))
        if n > 1:
            return UNSUPPORTED
        if n == 1:
            if first != self.last + 1 and self.commit < commit < self.last:
                self.last = self.commit
            if first != self.last + 1:
                return WRONG_INDEX
            self.last += 1
        return OK


def solve_appends(requests: DataFrame, node: str = "node", seq: str = "seq") -> DataFrame:
    """(node, seq, code, term, last_idx, commit_idx) after each of requests (node, seq, leader, term, commited, first_idx, n).

    A node's requests are a fold in order of seq: they are streamed through one
    task, of which a node is the least share; its state is three numbers.
    """
    names = [node, seq, "code", "term", "last_idx", "commit_idx"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f = None, Follower()
        for pdf in pdfs:
            out = []
            for who, s, leader, term, commit, first, n in pdf.itertuples(index=False):
                if who != now:
                    now, f = who, Follower()
                code = f.solve(leader, term, commit, None if pd.isna(first) else int(first), n)
                out.append((who, s, code, f.term, f.last, f.commit))
            yield pd.DataFrame(out, columns=names)

    rows = requests.select(node, seq, "leader", "term", "commited", "first_idx", "n").repartition(node).sortWithinPartitions(node, seq)
    kind = {c: requests.schema[c].dataType.simpleString() for c in (node, seq)}
    return rows.mapInPandas(run, f"{node} {kind[node]}, {seq} {kind[seq]}, code int, term long, last_idx long, commit_idx long")


# -- reads of a cluster ------------------------------------------------------------


def first_response(replicas: DataFrame, key: str, value: str, node: str, seq: str) -> DataFrame:
    """Each key's value at the first node that has one."""
    per = replicas.groupBy(key, node).agg(F.max_by(value, seq).alias(value))
    return per.groupBy(key).agg(F.min_by(value, node).alias(value), F.min(node).alias(node))


def replica_get(requests: DataFrame, log: DataFrame, applied: DataFrame, key: str = "k", value: str = "v", idx: str = "idx") -> DataFrame:
    """requests (k, node) with the value that the asked node has, by what it has applied (node, applied_idx) of the log; it may be stale.

    found tells a miss, or an unknown node, from any value.
    """
    a = applied.select(F.col("node").alias("_node"), "applied_idx")
    ask = requests.join(a, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("_ask", F.col(key))
    rows = log.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(idx).alias("_i"))
    some = ask.select("_ask", "node", "applied_idx").distinct().join(rows, (F.col("_ask") == F.col("_k")) & (F.col("_i") <= F.col("applied_idx")))
    got = some.groupBy("_k", "node").agg(F.max_by("_v", "_i").alias(value), F.lit(True).alias("_hit")).withColumnRenamed("node", "_n")
    out = ask.join(got, (F.col("_ask") == F.col("_k")) & (F.col("node") == F.col("_n")), "left")
    return out.select(*requests.columns, value, F.coalesce("_hit", F.lit(False)).alias("found"))


def leader_get(requests: DataFrame, log: DataFrame, nodes: DataFrame, leader, key: str = "k", value: str = "v", idx: str = "idx") -> DataFrame:
    """requests (k, node) answered by the leader, which another node names in its answer if it knows it.

    nodes: (node, leader_known, applied_idx).  code is that of the asked node;
    redirected says whether the leader was then asked, whose value is given.
    """
    known = nodes.select(F.col("node").alias("_n"), "leader_known")
    code = F.when(F.col("node") == leader, OK).when(F.coalesce("leader_known", F.lit(False)), ELSEWHERE).otherwise(FAILED)
    ask = requests.join(known, F.col("node") == F.col("_n"), "left").withColumn("code", code).drop("_n", "leader_known")
    ask = ask.withColumnRenamed("node", "_asked").withColumn("node", F.when(F.col("code") != FAILED, F.lit(leader)))
    got = replica_get(ask, log, nodes.select("node", "applied_idx"), key, value, idx)
    return got.select(key, F.col("_asked").alias("node"), "code", (F.col("code") == ELSEWHERE).alias("redirected"), value, "found")
