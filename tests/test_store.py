"""Store, compaction, caches and log rules against plain Python models."""

import bisect
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from keelson.engine import Engine
from keelson.functions import order
from keelson.operators import cache, latest, log, segments, sketch
from keelson.schemas import MANIFEST
from keelson.sources import config
from keelson.sources.journal import Journal
from keelson.sources.store import Store
from keelson.streaming import apply, nodes


def rows(spark, data):
    return spark.createDataFrame(data, "k string, v string, seq long")


def test_store_is_a_dict(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri(), thresholds=(60, 200))
    rng, model, seq = random.Random(4), {}, 0
    for _ in range(4):
        batch = []
        for _ in range(12):
            seq += 1
            k, v = rng.choice(["", "é", "9", "10", "B", "a", *map(str, range(20))]), f"v{seq}"
            model[k] = v
            batch.append((k, v, seq))
        s.put_batch(rows(spark, batch))
        s.compact()
    assert {r.k: r.v for r in s.view().collect()} == model
    assert s.get("10") == model.get("10") and s.get("missing") is None
    assert [r.k for r in s.scan("1", "2").collect()] == sorted(k for k in model if "1" <= k <= "2")
    found = {r.k: r.found for r in s.multi_get(spark.createDataFrame([("10",), ("nope",)], "k string")).collect()}
    assert found == {"10": "10" in model, "nope": False}
    before = s.view().collect()
    assert s.vacuum() and sorted(before) == sorted(s.view().collect())


def test_compaction_keeps_newest_and_uses_fresh_ids(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri(), thresholds=(1, 1, 10**9))
    s.put_batch(rows(spark, [("a", "old", 1), ("b", "x", 2)]))
    s.put_batch(rows(spark, [("a", "new", 3)]))
    assert s.compact() == 2
    m = s.manifest()
    assert [(r.level, r.first_key, r.last_key, r.n) for r in m] == [(2, "a", "b", 2)] and m[0].sst_id == 4
    assert s.get("a") == "new"


def test_compaction_of_many_levels_in_one_call(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri(), thresholds=(1, 1, 1, 1, 10**9))
    s.put_batch(rows(spark, [("a", "x", 1), ("é", "y", 2), ("", "z", 3)]))
    assert s.compact() == 4 and [(r.level, r.first_key, r.last_key) for r in s.manifest()] == [(4, "", "é")]
    assert s.get("") == "z" and s.get("é") == "y" and s.version() == 5
    s.vacuum()
    assert s.versions.numbers() == [5] and s.get("a") == "x"


def test_deleted_keys_stay_away_and_come_back_when_put(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri(), thresholds=(1, 10**9))
    s.put_batch(rows(spark, [("a", "1", 1), ("b", "1", 2), ("c", "1", 3)]))
    assert s.compact() == 1
    s.delete_batch(spark.createDataFrame([("a", 4), ("b", 5), ("none", 6)], "k string, seq long"))
    assert s.get("a") is None and s.get("c") == "1" and {r.k for r in s.view().collect()} == {"c"} and [r.k for r in s.scan("a", "z").collect()] == ["c"]
    assert {r.k: r.found for r in s.multi_get(spark.createDataFrame([("a",), ("c",)], "k string")).collect()} == {"a": False, "c": True}
    s.put_batch(rows(spark, [("b", "2", 7)]))
    assert s.compact() == 1 and s.get("b") == "2" and s.get("a") is None
    # nothing older is left, so the deletion itself has gone
    assert sum(r.n for r in s.manifest()) == 2
    s.delete_batch(spark.createDataFrame([("b", 8), ("c", 9)], "k string, seq long"))
    s.compact()
    assert s.view().count() == 0 and s.manifest() == [] and s.get("c") is None


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    s = Store(spark, tmp_path.as_uri())
    s.put_batch(rows(spark, [("a", "1", 1)]))
    with pytest.raises(Exception, match="(?i)exists"):
        s.versions.write(spark.createDataFrame([], MANIFEST), s.version())
    assert s.get("a") == "1"


def stream_rows():
    data = [(str(i % 7), f"v{i}", i) for i in range(60)]
    random.Random(1).shuffle(data)
    return data


def latest_upto(data, commit):
    return {k: v for k, v, seq in sorted(data, key=lambda r: r[2]) if seq <= commit}


def test_stream_flush_keeps_what_is_not_committed_yet(spark, tmp_path):
    data = stream_rows()
    rows(spark, data).write.parquet((tmp_path / "log").as_uri())
    s = Store(spark, (tmp_path / "db").as_uri())

    def flush(commit):
        src = apply.log_stream(spark, (tmp_path / "log").as_uri(), "k string, v string, seq long")
        apply.flush_to_store(src, s, (tmp_path / "cp").as_uri(), commit).awaitTermination()
        return {r.k: r.v for r in s.view().collect()}

    want = {r.k: r.v for r in log.replay(rows(spark, data), 40, "seq", "k", "v").collect()}
    assert flush(40) == want == latest_upto(data, 40)
    # no new rows, a greater commit index; then a lesser one, which changes nothing
    assert flush(50) == flush(45) == latest_upto(data, 50)
    more = [("3", "late", 33), ("0", "late", 44), ("1", "new", 61), ("new", "v62", 62)]
    rows(spark, more).write.mode("append").parquet((tmp_path / "log").as_uri())
    assert flush(61) == latest_upto(data + more, 61)
    s = Store(spark, (tmp_path / "db").as_uri())  # as after a restart
    j = Journal(spark, f"{s.base}/journal")
    assert j.state()[:2] == (61, 61) and flush(None) == latest_upto(data + more, 62)
    assert j.pending().count() == 0 and j.advance(1000) == 62 == j.advance(3)


def test_journal_rows_that_arrive_late_are_applied(spark, tmp_path):
    s, j = Store(spark, (tmp_path / "db").as_uri()), Journal(spark, (tmp_path / "j").as_uri())
    assert j.last() == 0 and j.apply(s) == 0
    j.append(rows(spark, [("a", "1", 1), ("b", "5", 5)]), 0)
    j.advance()
    assert j.apply(s) == 5
    j.append(rows(spark, [("c", "2", 2), ("a", "3", 3)]), 1)
    j.append(rows(spark, [("c", "2", 2), ("a", "3", 3)]), 1)
    j.append(spark.createDataFrame([("b", None, 6, 1)], "k string, v string, seq long, mode int"), 0, "other")
    j.advance()
    assert j.apply(s) == 6 and {r.k: r.v for r in s.view().collect()} == {"a": "3", "c": "2"}
    assert j.vacuum() == 1 and j.last() == 6


def test_engine(spark, tmp_path):
    (tmp_path / "c").write_text("0\n1 127.0.0.1 9001\n")
    with Engine(spark, (tmp_path / "db").as_uri(), (tmp_path / "c").as_uri()) as e:
        assert e.config.first().local.port == 9001
        kv = lambda *x: spark.createDataFrame(x, "k string, v string")
        assert e.put(kv(("a", "1"), ("b", "2"))) == (1, 2) and e.get("a") is None
        assert e.commit(1) == 1 and (e.get("a"), e.get("b")) == ("1", None)
        assert e.put(kv(("a", "3"))) == (3, 3) and e.delete(spark.createDataFrame([("b",)], "k string")) == (4, 4)
        assert e.commit(3) == 3 and (e.get("a"), e.get("b")) == ("3", "2")
    assert {r.k: r.v for r in Engine(spark, (tmp_path / "db").as_uri()).view().collect()} == {"a": "3"}
    assert Engine(spark, (tmp_path / "x").as_uri(), (tmp_path / "missing").as_uri()).config is None


def test_places_and_sums_over_many_ranges(spark):
    """Enough rows that Spark finds the bounds of ranges by sampling, and columns that a plan may prune."""
    n = 200_000
    df = spark.range(n).select(F.xxhash64("id").cast("string").alias("k"), (F.col("id") % 97).alias("v"), F.lit("x" * 20).alias("wide"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        data = sorted((r.k, r.v) for r in df.select("k", "v").collect())
        place = {k: i + 1 for i, (k, _) in enumerate(data)}
        got = order.with_position(df, ["k"]).select("k", "pos", "wide").toPandas()
        assert (got["pos"] == got["k"].map(place)).all() and got["pos"].nunique() == n
        upto, total, most, top, last, now = {}, 0, {}, 0, {}, None
        for k, v in data:
            total, top, now = total + v, max(top, v), v if v > 90 else now
            upto[k], most[k], last[k] = total, top, now
        got = order.with_sum(df, ["k"], "v", "s").toPandas()
        assert (got["s"] == got["k"].map(upto)).all()
        assert all(r.m == most[r.k] for r in order.with_max(df, ["k"], "v", "m").select("k", "m").collect())
        rare = df.withColumn("v", F.when(F.col("v") > 90, F.col("v")))
        assert all(r.m == last[r.k] for r in order.with_last(rare, ["k"], "v", "m").select("k", "m").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("limit", [30, 1000, 10**6])
def test_buffers_rotate_after_the_row_that_fills_them(spark, limit):
    rng = random.Random(limit)
    data = [(3 * i, rng.choice([1, 5, 17, 40, 400])) for i in range(3000)]
    want, number, held = {}, 0, 0
    for seq, size in data:
        want[seq] = number
        held += size
        if held > limit:
            number, held = number + 1, 0
    rng.shuffle(data)
    got = segments.rotate(spark.createDataFrame(data, "seq long, size long"), "seq", F.col("size"), limit)
    assert {r.seq: r.buffer for r in got.collect()} == want
    assert segments.rotate(spark.createDataFrame([], "seq long, size long"), "seq", F.col("size"), limit).count() == 0


def test_overlaps_by_brute_force(spark):
    rng = random.Random(8)

    def some(n):
        return [(i, *sorted(f"{rng.randrange(1000):03}" for _ in range(2))) for i in range(n)]

    a, b = some(120), some(90)
    of = lambda x: spark.createDataFrame(x, "sst_id long, first_key string, last_key string")
    got = sorted(map(tuple, segments.overlaps(of(a), of(b)).collect()))
    assert got == sorted((i, j) for i, f, t in a for j, g, u in b if t >= g and f <= u)
    assert segments.overlaps(of(a), of([])).count() == 0


def test_locate_many(spark):
    rng = random.Random(9)
    m = sorted({f"{rng.randrange(10**6):06}" for _ in range(300)})
    keys = [f"{rng.randrange(10**6):06}" for _ in range(2000)]
    got = segments.locate(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int"), spark.createDataFrame(list(zip(m, range(300), strict=False)), "first_key string, sst_id long"), "k", "sst_id")
    want = {i: (bisect.bisect_right(m, k) - 1 if bisect.bisect_right(m, k) else None) for i, k in enumerate(keys)}
    assert {r.i: r.sst_id for r in got.collect()} == want


def test_commands_see_earlier_puts(spark):
    base = rows(spark, [("a", "0", 1)])
    cmds = spark.createDataFrame([(1, "get", "a", None), (2, "put", "a", "1"), (3, "sget", "a", None), (4, "get", "z", None)], "seq long, op string, k string, v string")
    got = {r.seq: (r.v, r.found) for r in latest.commands(cmds, base).collect()}
    assert got == {1: ("0", True), 3: ("1", True), 4: (None, False)}


def test_optget_reads_one_replica(spark):
    base = rows(spark, [("a", "0", 1), ("a", "1", 5)])
    cmds = [(1, "put", "a", "2", None), (2, "get", "a", None, None), (3, "optget", "a", None, 0), (4, "optget", "a", None, 1), (5, "optget", "a", None, 9)]
    cmds = spark.createDataFrame(cmds, "seq long, op string, k string, v string, idx long")
    applied = spark.createDataFrame([(0, 3), (1, 5)], "node long, applied_idx long")
    got = {r.seq: (r.v, r.found) for r in latest.commands(cmds, base, applied).collect()}
    assert got == {2: ("2", True), 3: ("0", True), 4: ("1", True), 5: (None, False)}


def test_append_stops_where_the_ring_is_full(spark):
    have = spark.createDataFrame([(i,) for i in range(1, 6)], "idx long")
    new = spark.createDataFrame([(f"k{i}",) for i in range(5)], "k string")
    got = [(r.idx, r.k, r.term, r.mode) for r in log.append(have, new, 3, ["k"], ring=8).orderBy("idx").collect()]
    assert got == [(6, "k0", 3, 0), (7, "k1", 3, 0), (8, "k2", 3, 0)]
    empty = spark.createDataFrame([], "idx long")
    assert [r.idx for r in log.append(empty, new, 3, ["k"]).orderBy("idx").collect()] == [1, 2, 3, 4, 5]


def test_follower_answers():
    f = log.Follower()
    assert f.solve("a", 1, 0, 1, 1) == log.OK and (f.term, f.leader, f.last) == (1, "a", 1)
    assert f.solve("a", 1, 1, None, 0) == log.OK and f.commit == 1
    assert f.solve("a", 1, 1, 5, 1) == log.WRONG_INDEX and f.last == 1
    assert f.solve("a", 1, 1, 2, 2) == log.UNSUPPORTED and f.last == 1
    assert f.solve("a", 1, 1, 2, 1) == f.solve("a", 1, 1, 3, 1) == log.OK and f.last == 3
    assert f.solve("b", 2, 9, None, 0) == log.OK and (f.term, f.leader, f.commit) == (2, "b", 3)
    assert f.solve("a", 1, 0, 4, 1) == log.OK and f.leader == "b"


def test_a_group_without_a_majority_holds_writes_back(spark):
    acks = spark.createDataFrame([("g", i, m) for i, m in enumerate([9, 4, 4, 2])] + [(None, 0, 3)], "g string, node int, m long")
    writes = spark.createDataFrame([("g", 4), ("g", 5), ("x", 1), (None, 3), (None, 4)], "g string, idx long")
    got = {(r.g, r.idx): r.done for r in log.barrier(writes, acks, "g", "node", "m").collect()}
    assert got == {("g", 4): True, ("g", 5): False, ("x", 1): False, (None, 3): True, (None, 4): False}


@pytest.mark.parametrize("n,want", [(1, 10), (3, 20), (4, 20), (5, 30), (7, 40)])
def test_commit_index_is_a_majority(spark, n, want):
    acks = spark.createDataFrame([(0, i, 10 * (i + 1)) for i in range(n)], "g int, node int, m long")
    got = log.commit_index(acks, "g", "node", "m").first().commit_idx
    assert got == want and sum(10 * (i + 1) >= got for i in range(n)) >= n // 2 + 1


def test_lru_evicts_in_order_of_last_move():
    c = cache.Lru(99, 1)
    for i in range(100):
        c.put(str(i), i)
    assert c.get("0") is None
    c.put("101", 101)
    assert c.get("1") is None and c.get("2") == 2
    rng, mine, model = random.Random(2), cache.Lru(5, 0), OrderedDict()
    for _ in range(500):
        k = rng.randrange(9)
        if k in model:
            model.move_to_end(k)
        else:
            if len(model) == 5:
                model.popitem(last=False)
            model[k] = k
        if mine.get(k) is None:
            mine.put(k, k)
        assert set(mine.data) == set(model)


class Model:
    """The promotion rule on a plain list, front first: a touch adds to a count, and one that finds `promote` there moves the key to the front."""

    def __init__(self, capacity, promote):
        self.capacity, self.promote, self.list, self.count = capacity, promote, [], {}

    def touch(self, k):
        if self.count[k] >= self.promote:
            self.count[k] = 0
            self.list.insert(0, self.list.pop(self.list.index(k)))
        else:
            self.count[k] += 1

    def access(self, k, may=lambda old, new: True):
        if k in self.list:
            self.touch(k)
            return True, None
        out = None
        if len(self.list) == self.capacity:
            if not may(self.list[-1], k):
                return False, k
            out = self.list.pop()
        self.list.insert(0, k)
        self.count[k] = 0
        return False, out


class TwoModel:
    def __init__(self, capacity):
        self.window, self.main, self.freq = Model(max(1, capacity // 100), 0), Model(max(1, capacity - capacity // 100), 0), {}

    def access(self, k):
        self.freq[k] = min(15, self.freq.get(k, 0) + 1)
        for part in (self.window, self.main):
            if k in part.list:
                part.touch(k)
                return True, None
        _, out = self.window.access(k)
        if out is None:
            return False, None
        return False, self.main.access(out, lambda old, new: self.freq.get(old, 0) < self.freq.get(new, 0))[1]

    def halve(self):
        self.freq = {k: v // 2 for k, v in self.freq.items()}


@pytest.mark.parametrize("make,model,period,wide", [
    (lambda: cache.Lru(4, 2), lambda: Model(4, 2), None, 30), (lambda: cache.Lru(3, 0), lambda: Model(3, 0), None, 30),
    (lambda: cache.TinyLfu(4), lambda: TwoModel(4), 50, 30), (lambda: cache.TinyLfu(300), lambda: TwoModel(300), 70, 2000),
])
def test_caches_do_what_a_model_does_access_by_access(spark, make, model, period, wide):
    rng = random.Random(6)
    trace = [(i, min(rng.randrange(wide), rng.randrange(wide))) for i in range(3000)]
    want, state = [], {}
    for seq, k in trace:
        m, n = state.setdefault(k % 3, [model(), 0])
        want.append((k % 3, seq, k, *m.access(k)))
        state[k % 3][1] = n = n + 1
        if period and n % period == 0:
            m.halve()
    rng.shuffle(trace)
    df = spark.createDataFrame(trace, "seq long, k long")
    got = cache.replay(df, make, shard=F.col("k") % 3, period=period)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert any(hit for *_, hit, _ in want) and any(v is not None for *_, v in want)
    sums = {r.shard: (r.hits, r.misses, r.evictions) for r in cache.simulate(df, make, shard=F.col("k") % 3, period=period).collect()}
    assert sums == {s: tuple(sum(f(r) for r in want if r[0] == s) for f in (lambda r: r[3], lambda r: not r[3], lambda r: r[4] is not None)) for s in range(3)}


def test_peek_promotes_nothing():
    c = cache.Lru(2, 0)
    c.put("a", 1), c.put("b", 2)
    assert c.peek("a") == 1 and c.put("c", 3) == "a" and c.peek("a") is None
    t = cache.TinyLfu(4)
    t.access("a"), t.access("b")
    assert t.peek("a") == "a" and t.peek("z") is None and cache.shard_capacity(1024) == 17


def test_count_min_counts_and_ages(spark):
    items = spark.createDataFrame([(10,), (12,), (10,)], "x long")
    c = sketch.count_min(items, F.col("x"))
    est = lambda c: {r.x: r.estimate for r in sketch.count_min_estimate(items, "x", c).collect()}
    assert est(c) == {10: 2, 12: 1} and est(sketch.halved(c)) == {10: 1, 12: 0}
    many = spark.range(2000).select((F.col("id") % 300).alias("x"))
    got = {r.x: r.estimate for r in sketch.count_min_estimate(many.select("x"), "x", sketch.count_min(many, F.col("x"))).collect()}
    assert all(min(15, 2000 // 300) <= n for n in got.values()) and sum(n > 7 for n in got.values()) < 30


def test_aging_by_time_by_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randrange(5), rng.randrange(3000)) for _ in range(400)]
    df = spark.createDataFrame(data, "b long, t long").select("b", F.timestamp_seconds("t").alias("ts"))
    got = {r.bucket: r.estimate for r in sketch.aged_by_time(df, F.col("b"), F.col("ts"), F.timestamp_seconds(F.lit(3100)), 60).collect()}
    want = dict.fromkeys(range(5), 0)
    for w in range(3100 // 60 + 1):
        for b in want:
            want[b] = min(15, want[b] + sum(x == b and t // 60 == w for x, t in data))
            if w < 3100 // 60:
                want[b] >>= 1
    assert got == want


def test_bloom_survives_storage(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    b = sketch.Bloom.of(keys, "k", 1000)
    again = sketch.Bloom.load(spark, b.save(spark))
    assert all(b.might_contain(str(i)) for i in range(1000))
    wrong = [i for i in range(1000, 3000) if b.might_contain(str(i))]
    assert wrong == [i for i in range(1000, 3000) if again.might_contain(str(i))] and len(wrong) < 100


def test_config(spark):
    c = spark.createDataFrame([("0\n1 127.0.0.1 9001\n",)], "t string").select(config.parse(F.col("t")).alias("c")).first().c
    assert c.addresses == [] and tuple(c.local) == (1, "127.0.0.1", 9001)


def test_locate_before_the_first(spark):
    m = spark.createDataFrame([("b", 1), ("d", 2)], "first_key string, sst_id long")
    k = spark.createDataFrame([("a",), ("b",), ("c",), ("é",), (None,)], "k string")
    assert {r.k: r.sst_id for r in segments.locate(k, m, "k", "sst_id").collect()} == {"a": None, "b": 1, "c": 1, "é": 2, None: None}


def test_append_state_outlives_batches_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    kind = "node long, seq long, leader long, term long, commited long, first_idx long, n int"
    data, nth = [], dict.fromkeys(range(4), 0)
    for i in range(300):
        node = rng.randrange(4)
        nth[node] += 1
        n = rng.choice([0, 1, 1, 1, 2])
        data.append((node, i, rng.randrange(3), 1 + i // 100, rng.randrange(40), max(1, nth[node] - rng.randrange(3)) if n else None, n))
    want = sorted(map(tuple, log.solve_appends(spark.createDataFrame(data, kind)).collect()))
    at, out = (tmp_path / "in").as_uri(), (tmp_path / "out").as_uri()
    for part in (data[:120], data[120:200], data[200:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(at)
        src = spark.readStream.schema(kind).parquet(at)
        nodes.collect_appended(nodes.solve_appends(src), out, (tmp_path / "cp").as_uri())
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len({r[2] for r in want}) == 3


def test_silent_nodes_time_out(spark, tmp_path):
    at, out = (tmp_path / "in").as_uri(), (tmp_path / "out").as_uri()
    beats = [[(1, 0), (2, 0), (1, 3), (3, 1)], [(1, 6), (2, 4), (1, 14)], [(1, 40)], [(1, 41)]]
    for part in beats:
        spark.createDataFrame(part, "node long, t long").select("node", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(at)
        src = spark.readStream.schema("node long, ts timestamp").parquet(at)
        nodes.collect_appended(nodes.timeouts(src, 5), out, (tmp_path / "cp").as_uri())
    got = sorted((r.node, r.t) for r in spark.read.parquet(out).select("node", F.unix_timestamp("last_seen").alias("t")).collect())
    assert got == [(1, 6), (1, 14), (2, 4), (3, 1)]
