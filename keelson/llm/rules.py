"""Quality rules: counts over words, symbols and lines, and repetition by suffix array.

A suffix array over the words of a text, by prefix doubling, gives with its
longest-common-prefix values all maximal repeated word sequences: the longest
repeat that starts at a word is the larger of the values beside its suffix.
The union of these spans gives the covered fraction, the largest value the
longest repeat.  All texts of a batch are sorted together; the text is part of
the first key, so no repeat spans two.  Common prefixes are found by halving, on
hashes of word sequences, so a text costs some 100 bytes a word and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACE, Words, buffers, spans, texts, windows, within
from .store import in_arrow

#: Repeats of so many words count as covered.
MIN_REPEAT = 4
#: A text fails if more of its words are covered, or a repeat is longer.
MAX_COVERED = 0.30
MAX_REPEAT_WORDS = 100
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the number of words of the longest sequence from there that also starts elsewhere in its text."""
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.lexsort((word, doc))
    head = np.ones(n, bool)
    head[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    slot = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    word_rank, step = rank, 1
    ends = np.searchsorted(doc, doc, side="right")
    while True:
        size = np.bincount(rank, minlength=n)
        act = np.flatnonzero(size[rank] > 1)
        if not len(act):
            break
        nxt = act + step
        second = np.where(nxt < ends[act], rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, rank[act]))
        act, second, first = act[by], second[by], rank[act][by]
        new = np.ones(len(act), bool)
        new[1:] = first[1:] != first[:-1]
        at = np.arange(len(act)) - np.maximum.accumulate(np.where(new, np.arange(len(act)), 0)) + first
        new[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[act] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    pair = np.flatnonzero(word_rank[sa[1:]] == word_rank[sa[:-1]])
    a, b = sa[pair], sa[pair + 1]
    # sums of word hashes times powers: a sequence's hash is a difference of two, brought to one exponent
    power = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(word * power[:-1], out=upto[1:])
    lcp = np.zeros(len(pair), np.int64)
    while step:
        ok = np.flatnonzero((a + lcp + step <= ends[a]) & (b + lcp + step <= ends[b]))
        x, y = a[ok] + lcp[ok], b[ok] + lcp[ok]
        same = (upto[x + step] - upto[x]) * power[n - x] == (upto[y + step] - upto[y]) * power[n - y]
        lcp[ok[same]] += step
        step //= 2
    np.maximum.at(out, sa[pair], lcp)
    np.maximum.at(out, sa[pair + 1], lcp)
    return out


def measure(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row, and its repetition."""
    n = len(offs) - 1
    w = Words(raw, offs)
    h = w.hashes()

    def total(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(at) - 1, np.int64), at[1:] > at[:-1]
        if full.any():
            out[full] = np.add.reduceat(x, at[:-1][full], dtype=np.int64)
        return out

    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = total(~SPACE[raw] & ((raw & 0xC0) != 0x80), offs)
    out["n_symbols"] = total(_SYMBOL[raw], offs)
    # lines: from a row's start or past a newline, up to a newline or the row's end
    brk = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offs[:-1], brk + 1]))
    row = np.searchsorted(offs, start, side="right") - 1
    keep = (row < n) & (start < offs[np.minimum(row + 1, n)])
    start, row = start[keep], row[keep]
    if len(brk):
        nl = np.searchsorted(brk, start)
        end = np.minimum(np.where(nl < len(brk), brk[np.minimum(nl, len(brk) - 1)], len(raw)), offs[row + 1])
    else:
        end = offs[row + 1]
    start, at = np.unique(start, return_index=True)
    row, end = row[at], end[at]
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[has], end[has], row[has]
    line = spans(raw, start, end)
    by = np.lexsort((line, row))
    dup = np.zeros(len(by), bool)
    dup[1:] = (line[by][1:] == line[by][:-1]) & (row[by][1:] == row[by][:-1])
    out["n_dup_lines"] = np.bincount(row[by][dup], minlength=n)
    five = windows(h, 5)
    ok = np.flatnonzero(within(w.first, len(five), 5))
    by = ok[np.lexsort((five[ok], w.doc[ok]))]
    same = (five[by][1:] == five[by][:-1]) & (w.doc[by][1:] == w.doc[by][:-1])
    hit = np.zeros(len(w), np.int64)
    hit[by[1:][same]] = 1
    hit[by[:-1][same]] = 1
    out["n_repeat_words"] = total(_cover(hit * 5), w.first)
    rep = repeats(h, w.doc)
    out["covered_words"] = total(_cover(np.where(rep >= MIN_REPEAT, rep, 0)), w.first)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, rep)
    out["longest_repeat"] = longest
    return out


def _cover(length: np.ndarray) -> np.ndarray:
    """Items that the span of some item covers: length[i] items from i."""
    d = np.zeros(len(length) + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(d, at, 1)
    np.add.at(d, at + length[at], -1)
    return np.cumsum(d[:-1]) > 0


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def assess(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT_WORDS) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of docs.

    Null and empty texts have no words and fail the base rules; repeated rows
    are judged one by one; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            m = measure(*buffers(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m[c].astype(np.int64)) for c in _COUNTS]], ["doc_id", *_COUNTS])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = in_arrow(got, run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op10_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
