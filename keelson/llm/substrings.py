"""Exact removal of word sequences that an earlier document also holds.

A difference cover D of a period P has, for any two positions i and j, a shift
below P that brings both into D.  Two equal runs of P + W - 1 words therefore
hold equal W-word anchors that start at covered positions of both documents
at the same shift.  So only anchors at covered positions are hashed and
shuffled; where an anchor occurs in two documents, the full windows around it
are hashed in turn and settled by the least document that holds them.

Each worker settles among LOCAL_ROWS of its own rows first, and sends on one row
for each hash: a passage in a third of all documents costs one row for so many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, buffers, cover, texts, windows, within
from .store import in_arrow, keep, parts, scratch, spare

WINDOW = 13
#: Rows that one task of the settling shuffle holds, about 40 bytes each, and hashes that a worker settles among its own rows.
TASK_ROWS, LOCAL_ROWS = 500_000, 1 << 18


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences give every residue, by search in order of size."""
    from itertools import combinations

    for n in range(1, period + 1):
        for c in combinations(range(period), n):
            if len({(a - b) % period for a in c for b in c}) == period:
                return list(c)
    raise ValueError(period)


def shape(window: int) -> tuple[int, int, list[int]]:
    """Anchor width, period and cover for windows of so many words: width + period - 1 = window."""
    period = (window + 1) // 2
    return window + 1 - period, period, difference_cover(period)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the anchor that starts at each word, and whether one does: within its row and at a covered place."""
    width, period, residues = shape(window)
    h = windows(w.hashes(), width)
    ok = within(w.first, len(h), width)
    ok &= np.isin((np.arange(len(h)) - w.first[:-1][w.doc[: len(h)]]) % period, residues)
    return h, ok


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order of hash, then document."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, doc


#: What a row of the settling shuffle says: the least document of its batch; the same, and another of the batch has it too; a document already settled.
ALONE, SHARED, SETTLED = 0, 1, 2
_ROW = "h long, doc long, kind int"


def _settle_local(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    h, doc = _distinct(h, doc)
    kind = np.zeros(len(h), np.int32)
    if len(h):
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        size = np.diff(np.concatenate([np.flatnonzero(head), [len(h)]]))
        kind[head] = np.where(size > 1, SHARED, ALONE)
        kind[~head] = SETTLED
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(kind)], ["h", "doc", "kind"])


def _settle(least_too: bool) -> Callable:
    """Over a partition of rows by hash: the (doc, h) whose hash another document has (least_too), or a lesser one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, docs, kinds = [], [], []
        for b in batches:
            kind = b.column(2).to_numpy()
            out = kind == SETTLED
            h, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out])], ["doc", "h"])
            hs.append(h[~out])
            docs.append(doc[~out])
            kinds.append(kind[~out] == SHARED)
        if not hs:
            return
        h, doc, shared = np.concatenate(hs), np.concatenate(docs), np.concatenate(kinds)
        hs, docs, kinds = [], [], []
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        h, doc, shared = h[order], doc[order], shared[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        least = np.minimum.reduceat(doc, at)
        if least_too:
            many = np.logical_or.reduceat(shared, at) | (np.maximum.reduceat(doc, at) > least)
            out = many[group]
        else:
            out = doc > least[group]
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out])], ["doc", "h"])

    return run


def _settled(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the settling shuffle from (hashes, documents), of LOCAL_ROWS at a time."""
    hs, docs, held = [], [], 0
    for h, doc in found:
        hs.append(h)
        docs.append(doc)
        held += len(h)
        if held >= LOCAL_ROWS:
            yield _settle_local(np.concatenate(hs), np.concatenate(docs))
            hs, docs, held = [], [], 0
    if held:
        yield _settle_local(np.concatenate(hs), np.concatenate(docs))


def _by_hash(rows: DataFrame, n: int, least_too: bool) -> DataFrame:
    # settled rows only pass through, so they are spread evenly
    place = F.when(F.col("kind") == SETTLED, F.xxhash64("h", "doc")).otherwise(F.col("h"))
    told = in_arrow(rows.repartition(n, place), _settle(least_too), "doc long, h long")
    return told.groupBy("doc").agg(F.collect_set("h").alias("hs"))


def shared_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, hs): for each document the hashes of its windows that also start in a document with a lesser id.  Written.

    docs: (doc long, text string); rows of one id count as one document.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), size // 12 // TASK_ROWS + 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for part in texts(batches):
                w = Words(*buffers(part.column(1)))
                h, ok = _anchors(w, window)
                yield h[ok], part.column(0).to_numpy()[w.doc[: len(h)][ok]]

        yield from _settled(found())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, period, _ = shape(window)

        def found() -> Iterator[tuple]:
            for part in texts(batches):
                w = Words(*buffers(part.column(1)))
                h, ok = _anchors(w, window)
                told = part.column(2).to_numpy(zero_copy_only=False)
                for i, mine in enumerate(told):
                    a, b = w.first[i], max(w.first[i], w.first[i + 1] - width + 1)
                    ok[a:b] &= np.isin(h[a:b], np.asarray(mine, np.int64).view(np.uint64))
                full = windows(w.hashes(), window)
                # a window may hold an anchor that starts at its own first word or up to period - 1 later
                c = np.concatenate([[0], np.cumsum(ok)])
                at = np.arange(len(full))
                near = c[np.minimum(at + period, len(ok))] > c[np.minimum(at, len(ok))]
                near &= within(w.first, len(full), window)
                yield full[near], part.column(0).to_numpy()[w.doc[: len(full)][near]]

        yield from _settled(found())

    with scratch(spark):
        told = keep(_by_hash(in_arrow(docs, anchors, _ROW), n, True), "anchors")
        some = docs.join(told.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d")).select("doc", "text", "hs")
        return keep(_by_hash(in_arrow(some, candidates, _ROW), n, False), "windows", last=True)


def _cut_rows(part: pa.RecordBatch, window: int) -> tuple[list, list, list]:
    """For rows (text, hs): number of words, number removed, the kept words joined by one space."""
    w = Words(*buffers(part.column(part.schema.get_field_index("text"))))
    told = part.column(part.schema.get_field_index("hs")).to_numpy(zero_copy_only=False)
    h = windows(w.hashes(), window) if any(x is not None for x in told) else np.zeros(0, np.uint64)
    text = w.raw.tobytes()
    n_words, n_gone, kept = [], [], []
    for i, mine in enumerate(told):
        a, b = int(w.first[i]), int(w.first[i + 1])
        n_words.append(b - a)
        gone = np.zeros(b - a, bool)
        if mine is not None and b - a >= window:
            hit = np.isin(h[a : b - window + 1], np.asarray(mine, np.int64).view(np.uint64))
            gone = cover(hit, window, b - a)
        n_gone.append(int(gone.sum()))
        s, e = w.start[a:b][~gone].tolist(), w.end[a:b][~gone].tolist()
        kept.append(b" ".join([text[x:y] for x, y in zip(s, e, strict=True)]))
    return n_words, n_gone, kept


def _joined(docs: DataFrame, window: int) -> DataFrame:
    found = shared_windows(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc IS NOT NULL AND text IS NOT NULL"), window)
    return docs.join(found.withColumnRenamed("doc", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")


def _kept(docs: DataFrame, window: int, last: str, kind: pa.DataType, of) -> DataFrame:
    """(doc_id, n_words, n_removed, and `last` of what is kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            n, gone, kept = _cut_rows(part, window)
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([of(x) for x in kept], kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", last])

    got = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return in_arrow(got, run, f"doc_id long, n_words long, n_removed long, {last} string")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): documents without the words of windows that a lesser doc_id also holds.

    Windows are judged on the input.  kept has the remaining words joined by
    one space.  Null text counts as no words; a null id is lesser or greater
    than none, so such a row is returned whole; rows that repeat an id are one
    document and don't cut each other; an empty table gives an empty one.
    Other columns of docs are not read.
    """
    return _kept(docs, window, "kept", pa.string(), bytes.decode)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As cut_repeats, with the SHA-256 of the kept text in place of it."""
    return _kept(docs, window, "kept_sha256", pa.string(), lambda x: hashlib.sha256(x).hexdigest())


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut from text, and n_chars counted anew where it is a column.

    Texts that lose nothing keep their white space.  All rows and columns stay,
    whatever their names; see cut_repeats for nulls and repeated ids.
    """
    names, schema = docs.columns, docs.schema
    text = names.index("text")
    of, hs = spare(docs, "of", "hs")
    found = shared_windows(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc IS NOT NULL AND text IS NOT NULL"), window).toDF(of, hs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            old = part.column(text)
            _, gone, kept = _cut_rows(pa.RecordBatch.from_arrays([old, part.column(len(names))], ["text", "hs"]), window)
            new = pa.array([k.decode() if g else o for k, g, o in zip(kept, gone, old.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == text else part.column(i) for i in range(len(names))], names)

    got = docs.join(found, docs["doc_id"].cast("long") == found[of], "left").drop(of)
    out = in_arrow(got, run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out


def op9_difference_cover(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
