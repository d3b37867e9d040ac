"""Byte-level text kernel shared by the operators of this subpackage.

Everything works on whole batches of UTF-8 text at once: one flat byte array
plus offsets, as Arrow stores strings.  Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D; these are ASCII, so no code point is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one step of a worker holds as arrays.
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _pow
    while len(_pow) < n:
        top = np.uint64(pow(_BASE, len(_pow), 1 << 64))
        _pow = np.concatenate([_pow, _pow * top])
    return _pow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, col: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `step` bytes of text; a longer row stands alone."""
    if not batch.num_rows:
        return
    size = batch.column(batch.schema.get_field_index(col))
    _, offs = buffers(size)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + step, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a run of texts.

    start, end: byte bounds; doc: row of each word; first: for each row its
    first word's index, n + 1 long.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        n = len(offs) - 1
        inside = ~SPACE[raw]
        prev = np.empty(len(raw), bool)
        prev[1:] = inside[:-1]
        heads = offs[:-1][offs[:-1] < len(raw)]
        if len(raw):
            prev[0] = False
            prev[heads] = False
        begin = inside & ~prev
        last = np.empty(len(raw), bool)
        if len(raw):
            last[:-1] = ~inside[1:] | begin[1:]
            last[-1] = True
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(inside & last) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return spans(self.raw, self.start, self.end)


def texts(batches: Iterator[pa.RecordBatch], col: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices of all batches."""
    for batch in batches:
        yield from slices(batch, col, step)


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans ascend and don't overlap, empty ones hash alike."""
    out = np.zeros(len(start), np.uint64)
    size = end - start
    full = size > 0
    s, z = start[full], size[full]
    if len(s):
        # in runs of whole spans, so that the arrays over bytes stay small beside a long text
        upto, got, lo = np.cumsum(z), np.empty(len(s), np.uint64), 0
        while lo < len(s):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
            zz = z[lo:hi]
            if zz[0] > STEP_BYTES:
                got[lo], lo = _long(raw[s[lo] : s[lo] + zz[0]]), hi
                continue
            cum = np.concatenate([[0], np.cumsum(zz)])
            local = np.arange(cum[-1]) - np.repeat(cum[:-1], zz)
            v = _BYTE[raw[local + np.repeat(s[lo:hi], zz)]] * powers(int(zz.max()))[local]
            got[lo:hi] = np.add.reduceat(v, cum[:-1])
            lo = hi
        out[full] = got
    return mix(out + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _long(raw: np.ndarray) -> np.uint64:
    """What spans() sums for one long span, by blocks."""
    out, base = 0, 1
    step = pow(_BASE, STEP_BYTES, 1 << 64)
    for at in range(0, len(raw), STEP_BYTES):
        block = raw[at : at + STEP_BYTES]
        out += int((_BYTE[block] * powers(len(block))).sum(dtype=np.uint64)) * base
        base = base * step % (1 << 64)
    return np.uint64(out % (1 << 64))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive items of h, in one flat run; len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, c = h[:n].copy(), 1
    for j in range(1, width):
        c = c * _STEP % (1 << 64)
        out += h[j : j + n] * np.uint64(c)
    return mix(out)


def within(first: np.ndarray, n_windows: int, width: int) -> np.ndarray:
    """Which of the windows of a flat run lie in one row."""
    ok = np.zeros(max(n_windows, 0), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            ok[a : b - width + 1] = True
    return ok


def cover(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Items that some hit window of `width` covers, of n items."""
    d = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over undirected links a-b."""
    lab = np.arange(n)
    if not len(a):
        return lab
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, lab):
            return lab
        lab = new
