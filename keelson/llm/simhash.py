"""Near-duplicate documents by SimHash and a Gray-ordered index of masked patterns.

Fingerprints that differ in few bits agree wholly on at least one of several
masks, so the upper nodes of the index are the values under those masks; a node
with too many fingerprints is factored by the next level of masks.  A task
holds whole nodes: it sorts each one's fingerprints by Gray rank, builds a tree
whose nodes keep the bits all members share, and walks pairs of tree nodes from
the top, dropping both groups as soon as the differences of their shared bits
pass the limit.  All pairs within the limit are found; a task passes on only a
spanning star of each group it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import Words, buffers, labels, texts
from .store import in_arrow, keep, parts, scratch

NEAR_BITS = 3
#: A node with more fingerprints than this is factored by the next masks.
NODE_ROWS = 1024
LEVELS = 4
TASK_ROWS = 400_000
FAN = 4
#: Hashes that are taken or counted at once.
BLOCK = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint_rows(raw: np.ndarray, offs: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each row's word shingles: a bit is set if more than half of the XXH64s set it."""
    raw = _LOWER[raw]
    w = Words(raw, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(w):
        return out
    # one space between words: then a shingle is one slice
    size = w.end - w.start
    cum = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(cum[-1], 32, np.uint8)
    for i in range(0, len(w), BLOCK):
        some, n = size[i : i + BLOCK], np.cumsum(size[i : i + BLOCK])
        local = np.arange(n[-1]) - np.repeat(n - some, some)
        flat[local + np.repeat(cum[i : i + len(some)], some)] = raw[local + np.repeat(w.start[i : i + BLOCK], some)]
    text, begin, stop = flat.tobytes(), cum[:-1], cum[1:] - 1
    count = np.diff(w.first)
    sh = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), sh)
    at = np.arange(sh.sum()) - np.repeat(np.cumsum(sh) - sh, sh) + w.first[:-1][row]
    upto = np.minimum(at + width, w.first[1:][row]) - 1
    xx, h = xxhash.xxh64_intdigest, np.empty(len(at), np.uint64)
    for i in range(0, len(at), BLOCK):
        ends = zip(begin[at[i : i + BLOCK]].tolist(), stop[upto[i : i + BLOCK]].tolist(), strict=True)
        h[i : i + BLOCK] = np.fromiter((xx(text[a:b], seed) for a, b in ends), np.uint64)
    return fold(h, np.concatenate([[0], np.cumsum(sh)]))


def fold(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """SimHash of each run of 64-bit hashes: a bit is set if more than half of them set it; 0 for none."""
    out = np.zeros(len(bound) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
        votes = np.zeros(64, np.int64)
        for at in range(a, b, BLOCK):
            block = h[at : min(b, at + BLOCK)].astype(">u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.uint32)
        out[i] = np.packbits(votes * 2 > b - a).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            fp = fingerprint_rows(*buffers(part.column(1)), width=width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(small, run, "doc_id long, fp long")


def masks(levels: int = LEVELS, near: int = NEAR_BITS) -> list[list[int]]:
    """For each level the mask of each path; a path's children split the bits it left free into near + 1 runs."""
    out, free = [], [[*range(64)]]
    for _ in range(levels):
        level, rest = [], []
        for bits in free:
            cut = [round(i * len(bits) / (near + 1)) for i in range(near + 2)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                level.append(sum(1 << x for x in bits[a:b]))
                rest.append(bits[:a] + bits[b:])
        out.append(level)
        free = rest
    return out


def gray_rank(g: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    r = g.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def tree_pairs(fp: np.ndarray, first: np.ndarray, near: int = NEAR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within `near` bits inside each group; fp is in Gray order within groups, first has their bounds.

    fp has one 64-bit word a row, or a row of several; differences add up word
    by word, and a pair of groups is dropped as soon as they pass the limit.
    """
    fp = fp.reshape(len(fp), -1)
    ands, ors, starts = [fp], [fp], [first]
    while (np.diff(starts[-1]) > 1).any():
        size = np.diff(starts[-1])
        up = (size + FAN - 1) // FAN
        f = np.concatenate([[0], np.cumsum(up)])
        group = np.repeat(np.arange(len(up)), up)
        at = starts[-1][:-1][group] + (np.arange(f[-1]) - f[:-1][group]) * FAN
        ands.append(np.bitwise_and.reduceat(ands[-1], at, axis=0))
        ors.append(np.bitwise_or.reduceat(ors[-1], at, axis=0))
        starts.append(f)
    top = len(starts) - 1
    a = b = starts[top][:-1].copy()
    group = np.arange(len(a))
    for level in range(top - 1, -1, -1):
        above, below = starts[level + 1], starts[level]
        nxt = []
        same_and = ands[level]
        agree = ~(ands[level] ^ ors[level])
        la, lb = (a - above[group]) * FAN, (b - above[group]) * FAN
        lo, size = below[group], np.diff(below)[group]
        for i in range(FAN):
            for j in range(FAN):
                ok = (la + i < size) & (lb + j < size) & ((a != b) | (i <= j))
                x, y, g = (lo + la + i)[ok], (lo + lb + j)[ok], group[ok]
                gap = np.zeros(len(x), np.int32)
                for c in range(fp.shape[1]):
                    gap = gap + np.bitwise_count((same_and[x, c] ^ same_and[y, c]) & agree[x, c] & agree[y, c])
                    ok = gap <= near
                    x, y, g, gap = x[ok], y[ok], g[ok], gap[ok]
                nxt.append((x, y, g))
        a, b, group = (np.concatenate(z) for z in zip(*nxt, strict=True))
    ok = a != b
    return a[ok], b[ok]


def search(near: int, words: int = 1):
    """Over rows (k, node, fp, ...): links that join all pairs of nodes near each other under one k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        k, node, *cols = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(2 + words))
        fp = np.stack(cols, axis=1).view(np.uint64)
        order = np.lexsort((gray_rank(fp[:, 0]), k))
        k, node, fp = k[order], node[order], fp[order]
        bound = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
        size = np.diff(bound)
        s, z = bound[:-1][size > 1], size[size > 1]
        # groups of nodes whose pairs fit a step
        work = np.cumsum(z.astype(float) ** 2)
        cut = [0]
        while cut[-1] < len(z):
            done = work[cut[-1] - 1] if cut[-1] else 0
            cut.append(max(cut[-1] + 1, int(np.searchsorted(work, done + 4e6, side="right"))))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            zz = z[lo:hi]
            first = np.concatenate([[0], np.cumsum(zz)])
            idx = np.repeat(s[lo:hi] - first[:-1], zz) + np.arange(first[-1])
            n = node[idx]
            rank = np.argsort(n, kind="stable")
            place = np.empty(len(n), np.int64)
            place[rank] = np.arange(len(n))
            a, b = tree_pairs(fp[idx], first, near)
            if not len(a):
                continue
            root = labels(len(n), place[a], place[b])
            moved = root != np.arange(len(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(n[rank][moved]), pa.array(n[rank][root[moved]])], ["a", "b"]
            )

    return run


def near_links(nodes: DataFrame, near: int = NEAR_BITS) -> DataFrame:
    """Links (a, b) that join every two nodes whose fp differ in at most `near` bits, over a path if not directly.

    nodes: (node long, fp long) with distinct fp.
    """
    spark = nodes.sparkSession
    table = masks(LEVELS, near)

    def child(level: int, i: int) -> F.Column:
        path = F.col("path") * (near + 1) + i if level else F.lit(i)
        lits = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in table[level]])
        part = F.element_at(lits, (path + 1).cast("int")).bitwiseAND(F.col("fp"))
        key = F.xxhash64(F.col("k") if level else F.lit(0), path.cast("int"), part)
        return F.struct(key.alias("k"), path.cast("int").alias("path"))

    rows, done, total = nodes, [], nodes.count()
    for level in range(LEVELS):
        kids = F.explode(F.array(*[child(level, i) for i in range(near + 1)])).alias("x")
        rows = rows.select("node", "fp", kids).select("node", "fp", "x.k", "x.path")
        if level:
            rows = keep(rows, "nodes")
        if level == LEVELS - 1:
            done.append(rows)
            break
        full = keep(rows.groupBy("k").count().filter(F.col("count") > NODE_ROWS).select(F.col("k").alias("full")), "full")
        if not full.count():
            done.append(rows)
            break
        joined = rows.join(full, rows.k == full.full, "left")
        done.append(joined.filter("full IS NULL").select("node", "fp", "k", "path"))
        rows = joined.filter("full IS NOT NULL").select("node", "fp", "k", "path")
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)
    n = max(parts(spark), total * (near + 1) // TASK_ROWS + 1)
    return in_arrow(every.select("k", "node", "fp").repartition(n, "k"), search(near), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, near: int = NEAR_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id over links of at most `near` bits.

    Rows with a null id get a fingerprint and their class's component (null if
    no row of the class has an id); repeated ids are one document per text.
    Null, empty and blank texts share fingerprint 0.  An empty table gives an
    empty one.  Other columns of docs are not read.
    """
    fps = keep(fingerprints(docs, id_col, text_col, width), "fp")
    with scratch(docs.sparkSession):
        nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "fpnode")
        star = components(near_links(nodes.filter("node IS NOT NULL").select("node", "fp"), near))
        star = star.select(F.col("a").alias("_a"), "root")
        cls = nodes.join(star, nodes.node == star._a, "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component_id"))
        cls = keep(cls, "class", last=True)
    return fps.join(cls, fps.fp == cls._fp, "left").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
