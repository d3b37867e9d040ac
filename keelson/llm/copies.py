"""Near copies of texts: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8.

Two searches, and one exact check of every pair that either proposes:

1. SimHash.  A fingerprint of each set of shingles goes into the Gray-ordered
   index of masked patterns (simhash.py); texts that it joins are proposed as
   stars around one text of each group.  This joins most copies, however large
   their group is, by a row for each.
2. What no fingerprint of a fixed number of bits can promise.  Of two sets that
   similar, each has a shingle of the other among its first ones, a fifth of
   the set and one more, in any order that holds for all sets (prefix filter).
   So texts that are not in one group yet, but meet under a first shingle, are
   proposed too.  Frequent shingles, as a sample sees them, come last, which
   keeps such nodes small and decides nothing else.

Nodes over NODE_ROWS whose texts are in different groups are searched with two
more bounds.  A shingle that one text alone has, of all in such nodes, is shared
with none of them; a text with more than a fifth of those is near no other
(owned()).  The text with the least of them is a node's lead: what it is a copy
of, more or less.  All others are checked against it; what then is in different
groups is paired, in blocks, unless what they can share excludes it: of the
lead's shingles no more than the one that has fewer, and of those that are
neither the lead's nor their own the same.  So no pair of similar texts is left
unjoined.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .kernel import Words, buffers, mix, texts, windows
from .store import in_arrow, keep, parts, scratch, spare

WIDTH = 5
#: The least similarity of near copies, as a fraction.
PART, WHOLE = 4, 5
#: A node with more sets than this is searched by its lead first, then in blocks of BLOCK rows.
NODE_ROWS, BLOCK = 32, 1024
TASK_ROWS = 200_000
#: Pairs of one text that one task checks, about.
CHECK_ROWS = 256
#: One text in SAMPLE is looked at for frequent shingles; at most FREQUENT of them, in LEAST texts or more, are put last.
SAMPLE, FREQUENT, LEAST = 16, 1 << 17, 4
#: Pairs that one step of a worker holds, and bytes of text.
STEP, STEP_BYTES = 1 << 17, 1 << 19


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each row, a text of fewer words being one shingle."""
    w = Words(simhash._LOWER[raw], offs)
    h = w.hashes()
    g = windows(h, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        mine = h[:0] if a == b else windows(h[a:b], b - a) if b - a < width else g[a : b - width + 1]
        out.append(np.unique(mine))
    return out


def digest(shingles: np.ndarray) -> np.uint64:
    """A 64-bit hash of a set; 0 for the empty one."""
    return mix(shingles).sum(dtype=np.uint64)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([digest(s) for s in sets], np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def frequent(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and the number of sampled texts that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, step=STEP_BYTES):
            got = np.concatenate(shingle_sets(*buffers(part.column(0)), width))
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64))], ["k"])

    drawn = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    n = in_arrow(drawn, run, "k long").groupBy("k").count().filter(F.col("count") >= LEAST)
    top = n.orderBy(F.desc("count"), "k").limit(FREQUENT).toArrow()
    k, count = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(k)
    return k[order], count[order]


def prefix(shingles: np.ndarray, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by frequency and hash: every set similar to it has one of them among its own first."""
    n = len(shingles)
    if not n:
        return shingles
    first = n - (PART * n + WHOLE - 1) // WHOLE + 1
    if not len(often):
        return shingles[:first]
    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
    weight = np.where(often[at] == shingles, count[at], 0)
    return shingles[np.argsort(weight, kind="stable")[:first]]


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, c, fp, x, p) for every row: a hash of its text; digest, SimHash fingerprint, size and prefix of its set."""
    order = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, step=STEP_BYTES):
            sets = shingle_sets(*buffers(part.column(1)), width)
            x = np.array([len(s) for s in sets], np.int64)
            fp = simhash.fold(np.concatenate(sets), np.concatenate([[0], np.cumsum(x)]))
            p = _lists([prefix(s, *order.value) for s in sets])
            cols = [pa.array(v.view(np.int64)) for v in (digests(sets), fp, x)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols, p], ["doc_id", "h", "c", "fp", "x", "p"])

    return in_arrow(_texts(docs), run, "doc_id long, h long, c long, fp long, x long, p array<long>")


def whole_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(c, s): digest and shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, step=STEP_BYTES):
            sets = shingle_sets(*buffers(part.column(1)), width)
            yield pa.RecordBatch.from_arrays([pa.array(digests(sets).view(np.int64)), _lists(sets)], ["c", "s"])

    return in_arrow(docs.select("doc_id", "text"), run, "c long, s array<long>")


def _sized(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return WHOLE * np.minimum(x, y) >= PART * np.maximum(x, y)


def _meet(limit: int):
    """Over rows (k, c, x, r): pairs (a, b, x, y) of different r that meet in nodes of at most `limit` rows and in how many; of larger nodes the rows, with b null and r as y."""
    names = ["k", "a", "b", "x", "y", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        k, c, x, r = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4))
        order = np.lexsort((c, k))
        k, c, x, r = k[order], c[order], x[order], r[order]
        bound = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
        # a node of one group has nothing to join
        mixed = np.minimum.reduceat(r, bound[:-1]) < np.maximum.reduceat(r, bound[:-1])
        start, size = bound[:-1][mixed], np.diff(bound)[mixed]
        big = np.zeros(len(k), bool)
        for s, z in zip(start[size > limit].tolist(), size[size > limit].tolist(), strict=True):
            big[s : s + z] = True
        if big.any():
            none = pa.nulls(int(big.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(k[big]), pa.array(c[big]), none, pa.array(x[big]), pa.array(r[big]), none], names)
        start, size = start[size <= limit], size[size <= limit]
        work = np.cumsum(size * (size - 1) // 2)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + STEP, side="right")))
            # each row with all that follow it in its node
            left = np.concatenate([np.arange(s, s + z) for s, z in zip(start[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)])
            more = np.repeat(start[lo:hi] + size[lo:hi], size[lo:hi]) - left - 1
            a = np.repeat(left, more)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
            ok = _sized(x[a], x[b]) & (r[a] != r[b])
            a, b = a[ok], b[ok]
            order = np.lexsort((c[b], c[a]))
            a, b = a[order], b[order]
            if len(a):
                new = np.flatnonzero(np.concatenate([[True], (np.diff(c[a]) != 0) | (np.diff(c[b]) != 0)]))
                n = np.diff(np.concatenate([new, [len(a)]]))
                a, b = a[new], b[new]
                cols = [pa.nulls(len(a), pa.int64()), *[pa.array(v) for v in (c[a], c[b], x[a], x[b], n)]]
                yield pa.RecordBatch.from_arrays(cols, names)
            lo = hi

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (k, i, j, r, c, x, u, v, root, ks), whole blocks (k, i, j): pairs of different groups that may be similar.

    That is, whose sizes x, and what they have of the lead's (u) and of others'
    shingles (v), allow it.  Of the nodes ks that have both, the least gives
    the pair.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    k, i, j, r, c, x, u, v, root = (np.concatenate([b.column(n).to_numpy() for b in got]) for n in range(9))
    every = np.empty(len(k), object)
    every[:] = [z for b in got for z in b.column(9).to_pylist()]
    order = np.lexsort((c, j, i, k))
    k, i, j, r, c, x, u, v, root, every = (n[order] for n in (k, i, j, r, c, x, u, v, root, every))
    new = (np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    bound = np.concatenate([[0], np.flatnonzero(new) + 1, [len(k)]])
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        one = lo + np.flatnonzero(r[lo:hi] == i[lo])
        two = lo + np.flatnonzero(r[lo:hi] == j[lo])
        for at in range(0, len(one), max(1, STEP // max(1, len(two)))):
            a = one[at : at + max(1, STEP // max(1, len(two)))][:, None]
            b = two[None, :]
            ok = (root[a] != root[b]) & _sized(x[a], x[b])
            ok &= (PART + WHOLE) * (np.minimum(u[a], u[b]) + np.minimum(v[a], v[b])) >= PART * (x[a] + x[b])
            if i[lo] == j[lo]:
                ok &= a < b
            m, n = np.nonzero(ok)
            if len(m):
                a, b = a[m, 0], two[n]
                first = np.array([min(set(every[y]).intersection(every[z])) == k[lo] for y, z in zip(a.tolist(), b.tolist(), strict=True)], bool)
                a, b = c[a[first]], c[b[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (a, z, b, s) in order of a, z and b: a null b brings a's set, which the rows after it are compared with; gives (a, b, o, same)."""
    one = None
    for batch in batches:
        rows: list[tuple] = []
        lists = batch.column(3)
        flat, offs = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            mine = flat[offs[i] : offs[i + 1]].view(np.uint64)
            if b is None:
                one = mine
                continue
            if len(one) and len(mine):
                at = np.minimum(np.searchsorted(one, mine), len(one) - 1)
                both = int((one[at] == mine).sum())
            else:
                both = 0
            every = len(one) + len(mine) - both
            rows.append((a, b, both, both * WHOLE >= every * PART))
        a, b, o, same = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(z, pa.int64()) for z in (a, b, o)], pa.array(same, pa.bool_())], ["a", "b", "o", "same"])


def checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b, o, same) of every pair (a, b) of digests: how much the sets share, and whether they are similar.  Written.

    A set travels once to each task that needs it, and a text that is in many
    pairs is dealt to as many tasks as these fill.
    """
    need = keep(pairs.select(F.col("a").alias("_c")).union(pairs.select("b")).distinct(), "need")
    ids = nodes.join(need, nodes.c == need._c).select(F.col("node").alias("_node")).distinct()
    wanted = _texts(docs).join(ids, F.col("doc_id") == F.col("_node")).select("doc_id", "text")
    sets = keep(whole_sets(wanted, width).groupBy("c").agg(F.first("s").alias("s")), "sets")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECK_ROWS).alias("_m")).withColumnRenamed("a", "_a")
    dealt = pairs.join(many, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("_m")).alias("z"), "b")
    leads = dealt.select("a", "z").distinct().withColumn("b", F.lit(None).cast("long"))
    rows = leads.unionAll(dealt).withColumn("_of", F.coalesce("b", "a"))
    rows = rows.join(sets.withColumnRenamed("c", "_c"), F.col("_of") == F.col("_c")).select("a", "z", "b", "s")
    rows = rows.repartition(parts(docs.sparkSession), "a", "z").sortWithinPartitions("a", "z", F.col("b").asc_nulls_first())
    return keep(in_arrow(rows, _compare, "a long, b long, o long, same boolean"), "checked")


def owned(docs: DataFrame, nodes: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(c, own): how many shingles of each of the texts ids (c) no other of these has; texts without one are left out."""
    wanted = nodes.join(ids.select(F.col("c").alias("_c")), F.col("c") == F.col("_c")).select(F.col("node").alias("_node")).distinct()
    sets = whole_sets(_texts(docs).join(wanted, F.col("doc_id") == F.col("_node")).select("doc_id", "text"), width)
    # an id may have other texts, and a set several texts: a set that is here twice counts once
    each = sets.select("c", F.explode("s").alias("s")).groupBy("s").agg(F.min("c").alias("c"), F.max("c").alias("top")).filter("c = top")
    return keep(each.groupBy("c").agg(F.count("*").alias("own")), "owned")


def alike(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, near: int = simhash.NEAR_BITS) -> DataFrame:
    """Links (a, b) of similar sets among those that the SimHash index joins.  Written.

    The index joins texts of one fingerprint, and of fingerprints that differ
    in `near` bits at most; each text is checked against the least of its group.
    """
    least = keep(nodes.groupBy("fp").agg(F.min("c").alias("lead")).withColumnRenamed("fp", "_fp"), "leads")
    star = simhash.near_links(least.select(F.col("lead").alias("node"), F.col("_fp").alias("fp")), near)
    root = components(star).select(F.col("a").alias("_a"), "root")
    led = nodes.join(least, F.col("fp") == F.col("_fp")).select("c", "lead")
    led = led.join(root, F.col("lead") == F.col("_a"), "left").select(F.coalesce("root", "lead").alias("a"), F.col("c").alias("b"))
    return checked(docs, nodes, keep(led.filter("a <> b"), "alike"), width).filter("same").select("a", "b")


def near_links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b), each of two similar sets, that join all pairs of similar sets, over a path if not directly.

    nodes: (c, node, fp, x, p) with distinct c; docs has the text of every node.
    """
    spark = docs.sparkSession
    sure = alike(docs, nodes, width)
    root = components(sure).select(F.col("a").alias("_a"), "root")
    rows = nodes.join(root, F.col("c") == F.col("_a"), "left").select(F.explode("p").alias("k"), "c", "x", F.coalesce("root", "c").alias("r"))
    n = max(parts(spark), (nodes.agg(F.sum(F.size("p"))).first()[0] or 0) // TASK_ROWS + 1)
    met = keep(in_arrow(rows.repartition(n, "k"), _meet(NODE_ROWS), "k long, a long, b long, x long, y long, n long"), "met")
    hot = met.filter("b IS NULL").select("k", F.col("a").alias("c"), "x", F.col("y").alias("r"))
    pairs = met.filter("b IS NOT NULL").groupBy("a", "b").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("n").alias("n"))
    # what two sets share: n first shingles, those of large nodes, and at most the rest of one of them
    more = keep(hot.groupBy("c").agg(F.count("*").alias("h")), "more")
    for end in ("a", "b"):
        pairs = pairs.join(more.select(F.col("c").alias(f"_{end}"), F.col("h").alias(f"h{end}")), F.col(end) == F.col(f"_{end}"), "left")
    rest = lambda s: F.floor((PART * F.col(s) + WHOLE - 1) / WHOLE) - 1
    most = F.col("n") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) + F.greatest(rest("x"), rest("y"))
    pairs = keep(pairs.filter(most * (PART + WHOLE) >= (F.col("x") + F.col("y")) * PART).select("a", "b"), "pairs")
    own = owned(docs, nodes, more, width).withColumnRenamed("c", "_c")
    hot = hot.join(own, F.col("c") == F.col("_c"), "left").withColumn("y", F.col("x") - F.coalesce("own", F.lit(0)))
    hot = hot.filter(F.col("y") * WHOLE >= F.col("x") * PART).select("k", "c", "x", "y", "r")
    lead = F.min_by("c", F.struct(-(F.col("y") / F.col("x")), F.col("c")))
    size = hot.groupBy("k").agg(lead.alias("_lead"), F.min("r").alias("_r"), F.max("r").alias("_s")).filter("_r < _s").select(F.col("k").alias("_k"), "_lead")
    hot = keep(hot.join(keep(size, "large"), F.col("k") == F.col("_k")).drop("_k", "r"), "hot")
    if hot.isEmpty():
        return sure.unionAll(checked(docs, nodes, pairs, width).filter("same").select("a", "b"))
    led = hot.filter("c <> _lead").select(F.col("_lead").alias("a"), F.col("c").alias("b"))
    first = checked(docs, nodes, keep(pairs.unionAll(led).distinct(), "first"), width)
    links = sure.unionAll(first.filter("same").select("a", "b"))
    star = components(links).select(F.col("a").alias("_a"), "root")
    hot = hot.join(star, F.col("c") == F.col("_a"), "left").withColumn("root", F.coalesce("root", "c"))
    shared = first.select(F.col("a").alias("_u"), F.col("b").alias("_v"), "o")
    hot = hot.join(shared, (F.col("_lead") == F.col("_u")) & (F.col("c") == F.col("_v")), "left").withColumn("u", F.coalesce("o", "y"))
    hot = keep(hot.select("k", "c", "x", "u", (F.col("y") - F.col("u")).alias("v"), "root"), "hot")
    mixed = hot.groupBy("k").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.count("*").alias("_n")).filter("_r <> _s")
    hot = hot.join(mixed.select(F.col("k").alias("_k"), "_n"), F.col("k") == F.col("_k"))
    hot = keep(hot.drop("_k"), "mixed")
    # a text is in no more nodes than it has first shingles
    in_all = hot.groupBy("c").agg(F.collect_list("k").alias("ks")).withColumnRenamed("c", "_c")
    hot = hot.join(in_all.hint("merge"), F.col("c") == F.col("_c"))  # lists are larger than their files say
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    hot = hot.withColumn("r", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    hot = hot.select("k", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "r", "c", "x", "u", "v", "root", "ks")
    late = in_arrow(hot.repartition(parts(spark), "k", "i", "j"), _across, "a long, b long").distinct()
    late = checked(docs, nodes, keep(late, "late"), width).filter("same").select("a", "b")
    return links.unionAll(late)


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, component_id): component_id is the least doc_id over links of near copies, h a hash of the text.

    Texts are alike if their sets of shingles have a Jaccard similarity of at
    least PART / WHOLE.  Equal, and all null or blank, texts are copies.  Rows
    with a null id get their class's component; rows that repeat an id and a
    text are one document, and those of one id with different texts one for
    each; an empty table gives an empty one.  Other columns of docs are not read.
    """
    fps = keep(sketches(docs, width), "sketch")
    with scratch(docs.sparkSession):
        nodes = fps.groupBy("c").agg(F.min("doc_id").alias("node"), *[F.first(n).alias(n) for n in ("fp", "x", "p")])
        nodes = keep(nodes, "nodes")
        star = components(near_links(docs, nodes.filter("node IS NOT NULL"), width)).select(F.col("a").alias("_a"), "root")
        cls = nodes.join(star, nodes.c == star._a, "left").select("c", "node", F.coalesce("root", "c").alias("root"))
        least = cls.groupBy("root").agg(F.min("node").alias("component_id")).withColumnRenamed("root", "_root")
        cls = keep(cls.join(least, F.col("root") == F.col("_root")).select(F.col("c").alias("_c"), "component_id"), "class", last=True)
    return fps.join(cls, F.col("c") == F.col("_c"), "left").select("doc_id", "h", "component_id")


def keep_representatives(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with only the least doc_id of each group of near copies.

    Rows without an id stay, and all rows that repeat the least one.  All
    columns stay, whatever their names.
    """
    gone, of = spare(docs, "gone", "of")
    with scratch(docs.sparkSession):
        rows = near_copies(docs, width).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("h").alias(of)).distinct()
        rows = keep(rows, "gone", last=True)
    return docs.join(rows, (docs["doc_id"].cast("long") == rows[gone]) & (F.xxhash64(docs["text"]) == rows[of]), "left_anti")
