"""Named queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import byte_size, with_position
from ..operators import cache, latest, log, segments, sketch
from ..sources import config
from ..streaming import apply

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir: str) -> DataFrame:
    """events as a versioned table: k, v, seq."""
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL AND value IS NOT NULL")
    return e.select(F.col("user_id").cast("string").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("seq"))


_E = "e AS (SELECT CAST(user_id AS VARCHAR) AS k, value AS v, event_id AS seq FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"


def _orders(spark, sf_dir: str) -> DataFrame:
    """orders as key-value rows in sixteen segments by order key."""
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 16).alias("sst_id"))


_O = "o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice AS v, o_orderkey % 16 AS sst_id FROM orders)"


# -- latest-wins views and look-ups ------------------------------------------


@query(f"WITH {_E} SELECT k, arg_max(v, seq) AS v FROM e GROUP BY k")
def latest_wins(spark, sf_dir):
    return latest.latest(_events(spark, sf_dir))


@query(f"WITH {_E} SELECT k, v, seq FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1")
def latest_wins_ranked(spark, sf_dir):
    return latest.latest_ranked(_events(spark, sf_dir), "k", "seq")


@query(f"WITH {_E} SELECT k, arg_max(v, seq) AS v FROM e WHERE k = '13' GROUP BY k")
def point_get(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("value IS NOT NULL").select("user_id", F.col("value").alias("v"), F.col("event_id").alias("seq"))
    # the key as it is stored, so that the filter reaches the scan
    return latest.point_get(e, 13, "user_id").select(F.col("user_id").cast("string").alias("k"), "v")


@query(
    "WITH v AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) "
    "SELECT c_custkey AS k, v.v AS v, v.o_custkey IS NOT NULL AS found FROM customer LEFT JOIN v ON c_custkey = o_custkey"
)
def multi_get(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return latest.multi_get(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), latest.latest(o))


@query(
    f"WITH {_E}, s AS (SELECT *, CAST(seq % 4 AS INT) AS level FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, seq DESC) AS r FROM s) "
    "SELECT k, v, level FROM r WHERE r = 1"
)
def first_hit_levels(spark, sf_dir):
    s = _events(spark, sf_dir).withColumn("level", (F.col("seq") % 4).cast("int"))
    return latest.first_hit(s, "k", "v", "level", "seq")


@query(
    f"WITH {_E}, live AS (SELECT k, arg_max(v, seq) AS v FROM e GROUP BY k) "
    "SELECT k, v FROM live WHERE k NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)"
)
def buffer_delete(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("k"))
    return latest.delete_keys(latest.latest(_events(spark, sf_dir)), gone)


@query(
    "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS k, value AS v, event_id AS seq, CASE WHEN event_type = 'refund' OR event_id % 10 = 0 THEN 1 ELSE 0 END AS mode "
    "FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM l) SELECT k, v FROM r WHERE r = 1 AND mode = 0"
)
def log_delete(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("value IS NOT NULL")
    mode = F.when((F.col("event_type") == "refund") | (F.col("event_id") % 10 == 0), 1).otherwise(0)
    rows = e.select(F.col("user_id").cast("string").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("seq"), mode.alias("mode"))
    return latest.without_deleted(rows)


@query(
    "WITH live AS (SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(max(o_orderkey) AS VARCHAR) AS v FROM orders GROUP BY 1) "
    "SELECT count(*) AS entries, CAST(sum(strlen(k) + strlen(v)) AS BIGINT) AS bytes FROM live"
)
def memtable_bytes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.max("o_orderkey").cast("string").alias("v"))
    return o.agg(F.count(F.lit(1)).alias("entries"), F.sum(byte_size("k", "v")).alias("bytes"))


@query(f"WITH {_E}, live AS (SELECT k, arg_max(v, seq) AS v FROM e GROUP BY k) SELECT k, v, row_number() OVER (ORDER BY k) AS pos FROM live")
def ordered_scan(spark, sf_dir):
    return with_position(latest.latest(_events(spark, sf_dir)), ["k"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice AS v FROM orders WHERE CAST(o_orderkey AS VARCHAR) BETWEEN '10' AND '20'")
def range_scan(spark, sf_dir):
    return _orders(spark, sf_dir).filter(F.col("k").between("10", "20")).select("k", "v")


# -- segments, manifest, compaction ---------------------------------------------


@query(f"WITH {_O} SELECT sst_id, min(k) AS first_key, max(k) AS last_key, count(*) AS n, CAST(sum(strlen(k)) AS BIGINT) AS bytes FROM o GROUP BY sst_id")
def segment_minmax(spark, sf_dir):
    return segments.describe(_orders(spark, sf_dir), "sst_id", "k")


_RANGES = "SELECT CAST(o_orderkey AS VARCHAR) AS k, substr(CAST(o_orderkey AS VARCHAR), 1, 2) AS p FROM orders"


@query(
    f"WITH r AS ({_RANGES}), m AS (SELECT min(k) AS first_key, CAST(p AS BIGINT) AS sst_id FROM r GROUP BY p), "
    "q AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT q.k, m.sst_id FROM q ASOF LEFT JOIN m ON q.k >= m.first_key"
)
def asof_segment_lookup(spark, sf_dir):
    r = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    m = segments.describe(r.withColumn("sst_id", F.substring("k", 1, 2).cast("long")), "sst_id", "k")
    keys = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")).distinct()
    return segments.locate(keys, m, "k", "sst_id")


@query(
    f"WITH r AS ({_RANGES}), m AS (SELECT p, min(k) AS f, max(k) AS l FROM r GROUP BY p), "
    "b AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_custkey % 8 AS s FROM orders), n AS (SELECT s, min(k) AS f, max(k) AS l FROM b GROUP BY s) "
    "SELECT CAST(m.p AS BIGINT) AS left_id, n.s AS right_id FROM m JOIN n ON m.l >= n.f AND m.f <= n.l"
)
def segment_overlap(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").cast("string").alias("k")).withColumn("sst_id", F.substring("k", 1, 2).cast("long"))
    b = o.select(F.col("o_custkey").cast("string").alias("k"), (F.col("o_custkey") % 8).alias("sst_id"))
    return segments.overlaps(segments.describe(r, "sst_id", "k"), segments.describe(b, "sst_id", "k"))


@query(
    "WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, max(l_extendedprice) AS v FROM lineitem GROUP BY 1), "
    "b AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM b FULL JOIN a ON a.k = b.k"
)
def compaction_merge(spark, sf_dir):
    old = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    new = _orders(spark, sf_dir).filter(F.col("k").cast("long") % 3 == 0)
    return segments.merge([new, old], "k", "v")


@query(
    f"WITH {_O}, m AS (SELECT sst_id, min(k) AS f, max(k) AS l FROM o GROUP BY sst_id), "
    "u AS (SELECT CAST(1 AS INT) AS level, sst_id, f, l FROM m WHERE sst_id NOT IN (1, 2, 3) "
    "UNION ALL SELECT 1, 100, min(f), max(l) FROM m WHERE sst_id IN (1, 2, 3)) "
    "SELECT level, sst_id, f AS first_key, l AS last_key, row_number() OVER (PARTITION BY level ORDER BY f, sst_id) AS pos FROM u"
)
def compaction_splice(spark, sf_dir):
    m = segments.describe(_orders(spark, sf_dir), "sst_id", "k").withColumn("level", F.lit(1))
    new = m.filter("sst_id IN (1, 2, 3)").agg(F.lit(100).cast("long").alias("sst_id"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    return segments.splice(m, [1, 2, 3], new, 1)


@query(
    f"WITH {_O}, m AS (SELECT sst_id, CAST(sst_id % 3 AS INT) AS level, sum(strlen(k)) AS b FROM o GROUP BY sst_id) "
    "SELECT level, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS n, sum(b) > CASE level WHEN 0 THEN 1024 WHEN 1 THEN 10485760 ELSE 104857600 END AS \"full\" FROM m GROUP BY level"
)
def level_size_trigger(spark, sf_dir):
    m = segments.describe(_orders(spark, sf_dir), "sst_id", "k").withColumn("level", (F.col("sst_id") % 3).cast("int"))
    return segments.due(m)


# -- sketches ---------------------------------------------------------------------


@query("SELECT count(*) AS members, CAST(0 AS BIGINT) AS false_negatives FROM (SELECT DISTINCT o_custkey FROM orders)")
def bloom_probe(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k")).distinct()
    bits, of = sketch.probe(keys, "k")
    asked = keys.select("k", F.explode(of).alias("b")).join(bits, F.col("b") == F.col("bit"), "left")
    per = asked.groupBy("k").agg(F.count_if(F.col("bit").isNull()).alias("missing"))
    return per.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("missing") > 0).alias("false_negatives"))


@query("SELECT count(*) AS asked, true AS few FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def bloom_false_positives(spark, sf_dir):
    """Keys that aren't members: with 20 bits a member and four hashes under 0.2 % should pass; few says that under 2 % did."""
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k")).distinct()
    bits, of = sketch.probe(keys, "k", bits=20 * max(1, keys.count()))
    other = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")).distinct()
    asked = sketch.false_positives(latest.delete_keys(other, keys), "k", bits, of)
    return asked.select("asked", (F.col("passed") <= F.lit(0.02) * F.col("asked")).alias("few"))


_CM_BUCKET = "((user_id % 2147483647) * r.a + r.b) % 2147483647 & 63"
_CM_ROWS = "r AS (SELECT * FROM (VALUES (0, 48271, 11), (1, 69621, 23), (2, 16807, 47), (3, 39373, 89)) AS r(i, a, b)), u AS (SELECT user_id FROM events WHERE user_id IS NOT NULL)"


@query(
    f"WITH {_CM_ROWS}, c AS (SELECT r.i, {_CM_BUCKET} AS bucket, least(count(*), 15) AS n FROM u, r GROUP BY 1, 2), "
    f"q AS (SELECT DISTINCT user_id, r.i, {_CM_BUCKET} AS bucket FROM u, r) SELECT user_id, min(n) AS estimate FROM q JOIN c USING (i, bucket) GROUP BY user_id"
)
def count_min(spark, sf_dir):
    """A sketch narrow enough that keys collide in single rows."""
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id")
    return sketch.count_min_estimate(e, "user_id", sketch.count_min(e, F.col("user_id"), 6), 6)


@query(
    "WITH w AS (SELECT user_id & 1023 AS bucket, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2), "
    "l AS (SELECT bucket, list([w, n] ORDER BY w) AS ws, (SELECT CAST(floor(epoch(max(ts)) / 3600) AS BIGINT) FROM events WHERE user_id IS NOT NULL) AS last FROM w GROUP BY bucket), "
    "f AS (SELECT bucket, last, list_reduce(list_prepend([ws[1][1], 0], ws), lambda a, x: [x[1], least((a[2] >> least(x[1] - a[1], 5)) + x[2], 15)]) AS a FROM l) "
    "SELECT bucket, a[2] >> least(last - a[1], 5) AS estimate FROM f"
)
def freq_aging_by_time(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", "ts")
    end = e.agg(F.max("ts").alias("end"))
    return sketch.aged_by_time(e.join(F.broadcast(end)), F.col("user_id").bitwiseAND(F.lit(1023)), F.col("ts"), F.col("end"), 3600)


@query("SELECT user_id & 1023 AS bucket, least(count(*), 15) AS estimate FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def freq_sketch_sat(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return sketch.saturating(e, F.col("user_id").bitwiseAND(F.lit(1023)))


@query(
    "WITH e AS (SELECT user_id & 1023 AS bucket, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS epoch FROM events WHERE user_id IS NOT NULL), "
    "c AS (SELECT bucket, count(*) FILTER (epoch = 0) AS a, count(*) FILTER (epoch = 1) AS b FROM e GROUP BY bucket) "
    "SELECT bucket, least((least(a, 15) >> 1) + b, 15) >> 1 AS estimate FROM c"
)
def freq_aging(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return sketch.aged(e, F.col("user_id").bitwiseAND(F.lit(1023)), F.when(F.col("event_id") % 2 == 0, 0).otherwise(1), 2)


# -- caches -------------------------------------------------------------------------


@query("SELECT user_id AS k, max(event_id) AS last_seq FROM events GROUP BY user_id ORDER BY last_seq DESC LIMIT 50")
def lru_topk(spark, sf_dir):
    return cache.top_recent(_t(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id"), "k", "event_id", 50)


@query(
    "WITH r AS (SELECT user_id AS k, max(event_id) AS last_seq, user_id % 64 AS shard FROM events WHERE user_id IS NOT NULL GROUP BY user_id) "
    "SELECT k, last_seq, shard FROM r QUALIFY row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC) <= 2"
)
def lru_sharded_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("k"), "event_id")
    return cache.top_recent_sharded(e, "k", "event_id", F.col("k") % 64, 2)


_CONTENT = "r AS (SELECT user_id AS k, max(event_id) AS last_seq, user_id % 64 AS shard FROM events WHERE user_id IS NOT NULL GROUP BY user_id), "\
    "c AS (SELECT k, last_seq, shard FROM r QUALIFY row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC) <= 2)"


@query(f"WITH {_CONTENT} SELECT c_custkey AS k, c.k IS NOT NULL AS held FROM customer LEFT JOIN c ON c.k = c_custkey")
def lru_peek(spark, sf_dir):
    return cache.peek(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), lru_sharded_topk(spark, sf_dir), "k")


@query(f"WITH {_CONTENT} SELECT shard, count(*) AS size, count(*) >= 2 AS \"full\" FROM c GROUP BY shard")
def lru_sizes(spark, sf_dir):
    return cache.sizes(lru_sharded_topk(spark, sf_dir), 2)


def _trace(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k")).filter("k IS NOT NULL")


# a strict cache of two keys has a key if fewer than two others were touched since it was; what was missed and isn't there in the end was evicted
@query(
    "WITH t AS (SELECT event_id AS seq, user_id AS k, user_id % 16 AS shard, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events WHERE user_id IS NOT NULL), "
    "d AS (SELECT t.seq, t.shard, t.prev, count(DISTINCT q.k) AS others FROM t LEFT JOIN t AS q ON q.shard = t.shard AND q.seq > t.prev AND q.seq < t.seq GROUP BY 1, 2, 3), "
    "s AS (SELECT shard, count(*) FILTER (prev IS NOT NULL AND others < 2) AS hits, count(*) AS n FROM d GROUP BY shard), "
    "e AS (SELECT shard, least(count(DISTINCT k), 2) AS held FROM t GROUP BY shard) "
    "SELECT s.shard, hits, n - hits AS misses, n - hits - held AS evictions FROM s JOIN e USING (shard)"
)
def lru_sim(spark, sf_dir):
    return cache.simulate(_trace(spark, sf_dir), lambda: cache.Lru(2, 0), shard=F.col("k") % 16)


@query()
def lru_promotions(spark, sf_dir):
    """Keys move to the front on their third touch since they last did; every access with what it evicted."""
    return cache.replay(_trace(spark, sf_dir), lambda: cache.Lru(4, 2), shard=F.col("k") % 16)


@query()
def tinylfu_sim(spark, sf_dir):
    return cache.simulate(_trace(spark, sf_dir), lambda: cache.TinyLfu(4), shard=F.col("k") % 16, period=100)


# -- log and decisions -----------------------------------------------------------------


@query(f"WITH {_E} SELECT k, arg_max(v, seq) AS v FROM e WHERE seq <= 5000 GROUP BY k")
def log_replay_committed(spark, sf_dir):
    return log.replay(_events(spark, sf_dir), 5000, "seq", "k", "v")


@query(
    "WITH l AS (SELECT event_id AS idx FROM events WHERE event_id % 7 <> 3), p AS (SELECT idx, lag(idx) OVER (ORDER BY idx) AS before FROM l) "
    "SELECT idx, before IS NULL OR before + 1 = idx AS ok FROM p"
)
def log_contiguity(spark, sf_dir):
    return log.contiguity(_t(spark, sf_dir, "events").filter("event_id % 7 <> 3").select(F.col("event_id").alias("idx")), "idx")


@query("SELECT event_id AS idx, user_id FROM events WHERE event_id <= 3000")
def log_truncate(spark, sf_dir):
    return log.truncate(_t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "user_id"), 3000, "idx")


@query("SELECT event_id AS idx, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def log_ring_retention(spark, sf_dir):
    return log.retain(_t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "user_id"), "idx", 1000)


@query(
    "SELECT *, greatest(event_id % 100, least(event_id % 150, event_id % 130)) AS commit_idx FROM (SELECT event_id FROM events)"
)
def commit_advance(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id")
    return e.withColumn("commit_idx", log.advance(F.col("event_id") % 100, F.col("event_id") % 150, F.col("event_id") % 130))


@query(
    "WITH m AS (SELECT o_orderpriority AS grp, o_custkey AS node, max(o_orderkey) AS m FROM orders GROUP BY 1, 2), "
    "s AS (SELECT grp, list_sort(list(m), 'DESC') AS ms FROM m GROUP BY grp) SELECT grp, CAST(len(ms) AS BIGINT) AS nodes, ms[CAST(len(ms) // 2 AS BIGINT) + 1] AS commit_idx FROM s"
)
def commit_index_majority(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("m"))
    return log.commit_index(o, "grp", "node", "m")


_ACKS = "m AS (SELECT o_orderpriority AS grp, o_custkey AS node, max(o_orderkey) AS m FROM orders GROUP BY 1, 2)"


@query(
    f"WITH {_ACKS}, s AS (SELECT grp, list_sort(list(m), 'DESC') AS ms FROM m GROUP BY grp), c AS (SELECT grp, ms[CAST(len(ms) // 2 AS BIGINT) + 1] AS c FROM s) "
    "SELECT o_orderkey AS idx, grp, o_orderkey <= c AS done FROM orders JOIN c ON grp = o_orderpriority"
)
def write_barrier(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("m"))
    return log.barrier(o.select(F.col("m").alias("idx"), "grp"), o, "grp", "node", "m").select("idx", "grp", "done")


@query(
    "SELECT (SELECT max(event_id) FROM events WHERE event_id <= 9000) + row_number() OVER (ORDER BY o_orderkey) AS idx, CAST(7 AS BIGINT) AS term, CAST(0 AS INT) AS mode, o_custkey AS k FROM orders "
    "QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 10000 - (SELECT count(*) FROM events WHERE event_id <= 9000)"
)
def log_append(spark, sf_dir):
    """Orders appended to a log that has room for 10000 entries."""
    have = _t(spark, sf_dir, "events").filter("event_id <= 9000").select(F.col("event_id").alias("idx"))
    new = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return log.append(have, new, 7, ["o_orderkey"], ring=10_000).select("idx", "term", "mode", "k")


@query(
    "SELECT event_id AS idx, greatest(0, max(event_id % 1000 - 500) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS commit_idx FROM events"
)
def log_receive(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("event_id") % 1000 - 500).alias("commited"))
    return log.receive(e, "commited").select("idx", "commit_idx")


@query("SELECT event_id AS idx, user_id FROM events WHERE event_id = 77")
def log_entry_at(spark, sf_dir):
    return log.at(_t(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "user_id"), 77)


@query(
    "SELECT user_id AS node, event_id AS seq, event_id % 5 <> 0 AS done, "
    "CAST(3 + sum(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS match_idx FROM events WHERE user_id IS NOT NULL"
)
def replication_progress(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return log.progress(e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 != 0).alias("done")), "node", "seq", "done", 3)


_REQUESTS = (
    "q AS (SELECT user_id AS node, event_id AS seq, event_id % 4 AS leader, 1 + event_id // 4000 AS term, event_id % 13 AS commited, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 31 = 0 THEN 2 ELSE 1 END AS n FROM events WHERE user_id IS NOT NULL), "
    "a AS (SELECT *, CASE WHEN n > 0 THEN nth - nth // 6 - CASE WHEN seq % 17 = 0 THEN 4 ELSE 0 END END AS first_idx FROM q)"
)


@query(
    f"WITH RECURSIVE {_REQUESTS}, f(node, seq, nth, code, term, last_idx, commit_idx) AS ("
    "SELECT node, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT node FROM a) UNION ALL "
    "SELECT node, seq, nth, CASE WHEN n > 1 THEN -3 WHEN n = 1 AND first_idx <> base + 1 THEN -2 ELSE 0 END, term, CASE WHEN n = 1 AND first_idx = base + 1 THEN base + 1 ELSE base END, c FROM ("
    "SELECT *, CASE WHEN n = 1 AND first_idx <> last_idx + 1 AND commited > c AND commited < last_idx THEN c ELSE last_idx END AS base FROM ("
    "SELECT a.node, a.seq, a.nth, a.n, a.first_idx, a.commited, f.last_idx, greatest(f.commit_idx, least(f.last_idx, a.commited)) AS c, "
    "CASE WHEN a.term > f.term THEN a.term ELSE f.term END AS term FROM f JOIN a ON a.node = f.node AND a.nth = f.nth + 1))) "
    "SELECT node, seq, CAST(code AS INT) AS code, term, last_idx, commit_idx FROM f WHERE nth > 0"
)
def solve_append(spark, sf_dir):
    """Appends to every node as they come: some empty, some of two entries, some out of place, terms that rise."""
    e = _t(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    i = F.col("event_id")
    q = e.select(
        F.col("user_id").alias("node"), i.alias("seq"), (i % 4).alias("leader"), (1 + F.floor(i / 4000)).cast("long").alias("term"), (i % 13).alias("commited"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("nth"), F.when(i % 6 == 0, 0).when(i % 31 == 0, 2).otherwise(1).alias("n"),
    )
    first = F.col("nth") - F.floor(F.col("nth") / 6) - F.when(F.col("seq") % 17 == 0, 4).otherwise(0)
    return log.solve_appends(q.withColumn("first_idx", F.when(F.col("n") > 0, first.cast("long"))))


@query(
    "WITH l AS (SELECT r_regionkey AS leader, r_regionkey + 1 AS term, 10 * r_regionkey AS commit_idx FROM region), "
    "t AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:10', INTERVAL 1 SECOND)) AS TIMESTAMP) AS ts) "
    "SELECT leader, n_nationkey AS follower, ts, CAST(term AS BIGINT) AS term, CAST(commit_idx AS BIGINT) AS commit_idx FROM nation JOIN l ON n_regionkey = leader, t"
)
def heartbeat_rows(spark, sf_dir):
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("leader"), (F.col("r_regionkey") + 1).cast("long").alias("term"), (F.col("r_regionkey") * 10).cast("long").alias("commit_idx"))
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("leader"), F.col("n_nationkey").alias("follower"))
    return log.heartbeats(r, n, "2024-01-01 00:00:00", "2024-01-01 00:00:10")


@query(
    "WITH v AS (SELECT l_orderkey AS term, l_returnflag <> 'R' AS g FROM lineitem) "
    "SELECT term, count(*) AS votes, count(*) FILTER (g) AS granted, count(*) FILTER (g) * 2 > count(*) AS elected FROM v GROUP BY term"
)
def vote_majority(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("term"), (F.col("l_returnflag") != "R").alias("g"))
    return log.elections(v, "term", "g")


@query(
    "WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last_seen FROM events) "
    "SELECT user_id, ts, last_seen FROM g WHERE ts > last_seen + INTERVAL 3600 SECOND"
)
def heartbeat_gaps(spark, sf_dir):
    return log.gaps(_t(spark, sf_dir, "events"), "user_id", "ts", 3600)


@query(
    "WITH r AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey % 3 AS node, o_orderkey AS seq FROM orders WHERE o_orderkey % 5 <> o_custkey % 5), "
    "l AS (SELECT k, node, arg_max(v, seq) AS v FROM r GROUP BY k, node) SELECT k, arg_min(v, node) AS v, min(node) AS node FROM l GROUP BY k"
)
def replica_first_response(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_orderkey % 5 <> o_custkey % 5")
    r = o.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 3).alias("node"), F.col("o_orderkey").alias("seq"))
    return log.first_response(r, "k", "v", "node", "seq")


_NODES = "n AS (SELECT * FROM (VALUES (0, 4000, true), (1, 9000, true), (2, 1000, false)) AS n(node, applied_idx, leader_known))"
_ORDER_LOG = "l AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS idx FROM orders)"


def _cluster(spark, sf_dir):
    nodes = spark.createDataFrame([(0, 4000, True), (1, 9000, True), (2, 1000, False)], "node long, applied_idx long, leader_known boolean")
    ask = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 4).alias("node"))
    return ask, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("idx")), nodes


@query(
    f"WITH {_NODES}, {_ORDER_LOG}, g AS (SELECT l.k, n.node, arg_max(v, idx) AS v FROM l JOIN n ON idx <= applied_idx GROUP BY 1, 2) "
    "SELECT c_custkey AS k, c_custkey % 4 AS node, v, g.k IS NOT NULL AS found FROM customer LEFT JOIN g ON g.k = c_custkey AND g.node = c_custkey % 4"
)
def replica_read(spark, sf_dir):
    """Reads of one node each, which has applied its part of the log; node 3 doesn't exist."""
    ask, orders, nodes = _cluster(spark, sf_dir)
    return log.replica_get(ask, orders, nodes)


@query(
    f"WITH {_NODES}, {_ORDER_LOG}, g AS (SELECT k, arg_max(v, idx) AS v FROM l WHERE idx <= 9000 GROUP BY k), "
    "q AS (SELECT c_custkey AS k, c_custkey % 4 AS node, CASE WHEN c_custkey % 4 = 1 THEN 0 WHEN leader_known THEN -2 ELSE -1 END AS code FROM customer LEFT JOIN n ON node = c_custkey % 4) "
    "SELECT q.k, node, code, code = -2 AS redirected, CASE WHEN code <> -1 THEN v END AS v, g.k IS NOT NULL AND code <> -1 AS found FROM q LEFT JOIN g ON g.k = q.k"
)
def leader_read(spark, sf_dir):
    """Reads that want the leader, node 1; two of the others know or don't know it, one doesn't exist."""
    ask, orders, nodes = _cluster(spark, sf_dir)
    return log.leader_get(ask, orders, nodes, 1)


@query(
    "WITH v AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) "
    "SELECT count(*) AS asked, count(v.o_custkey) AS hits FROM customer LEFT JOIN v ON c_custkey = o_custkey"
)
def manifest_hits(spark, sf_dir):
    return segments.hits(multi_get(spark, sf_dir))


@query(
    "WITH a AS (SELECT n_nationkey AS id, n_name AS address FROM nation WHERE n_nationkey < 20) "
    "SELECT c_custkey, CASE WHEN c_nationkey = c_custkey % 25 THEN 0 WHEN a.address IS NULL THEN -1 ELSE -2 END AS code, "
    "CASE WHEN c_nationkey <> c_custkey % 25 THEN a.address END AS leader_address FROM customer LEFT JOIN a ON a.id = c_nationkey"
)
def leader_redirect(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("address"))
    c = _t(spark, sf_dir, "customer")
    return log.redirect(c, a, F.col("c_nationkey"), F.col("c_nationkey") == F.col("c_custkey") % 25).select("c_custkey", "code", "leader_address")


@query(
    "SELECT o_orderkey, (o_orderkey % 7 > 3 AND o_custkey % 50 >= 25) OR (o_orderkey % 7 = 3 AND o_custkey % 2 = 0 AND o_custkey % 50 >= 25) AS granted FROM orders"
)
def vote_grant(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    voted = F.when(F.col("o_custkey") % 2 == 1, F.lit(1))
    return o.select("o_orderkey", log.grant(F.col("o_orderkey") % 7, F.col("o_custkey") % 50, voted, F.lit(3), F.lit(25)).alias("granted"))


# -- streams and configuration -------------------------------------------------------------


@query(f"WITH {_E} SELECT k, arg_max(v, seq) AS v FROM e GROUP BY k")
def stream_latest_wins(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder: the table itself where it is one, else the files of that name beside it
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if _is_file(spark, path) else apply.log_stream(spark, path, schema)
    s = s.filter("user_id IS NOT NULL AND value IS NOT NULL").select(F.col("user_id").cast("string").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("seq"))
    return apply.run_to_table(apply.latest_stream(s, "k", "v", "seq"))


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query(
    "SELECT n.i AS id, '10.0.0.' || n.i AS ip, 9000 + n.i AS port, 3 AS peers, 4 AS local_id FROM (VALUES (1), (2), (3)) AS n(i)"
)
def config_parse(spark, sf_dir):
    text = "3\n1 10.0.0.1 9001\n2 10.0.0.2 9002\n3 10.0.0.3 9003\n4 10.0.0.4 9004\n"
    c = spark.createDataFrame([(text,)], "value string").select(config.parse(F.col("value")).alias("c"))
    return c.select(F.explode("c.addresses").alias("a"), F.size("c.addresses").alias("peers"), F.col("c.local.id").alias("local_id")).select("a.*", "peers", "local_id")


@query(
    "SELECT conv_id, arg_max(text, turn) AS v, max(turn) AS turn FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"
)
def latest_turn(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("v"), F.max("turn").alias("turn"))


@query(
    f"WITH RECURSIVE {_E}, b AS (SELECT seq, sum(strlen(k) + 8) OVER (ORDER BY seq) AS upto FROM e), "
    "r(buffer, base, stop) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), (SELECT min(upto) FROM b WHERE upto > 4096) UNION ALL "
    "SELECT buffer + 1, stop, (SELECT min(upto) FROM b WHERE upto > stop + 4096) FROM r WHERE stop IS NOT NULL) "
    "SELECT buffer, count(*) AS n, max(seq) AS last_seq FROM b JOIN r ON upto > base AND (stop IS NULL OR upto <= stop) GROUP BY buffer"
)
def buffer_rotation(spark, sf_dir):
    """Write buffers of 4 KiB, each left with the entry that takes it over that."""
    got = segments.rotate(_events(spark, sf_dir).select("k", "seq"), "seq", F.octet_length("k") + 8, 4096)
    return got.groupBy("buffer").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
