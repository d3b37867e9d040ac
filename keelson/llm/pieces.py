"""SentencePiece encoding and decoding as a max-plus scan over chunks of text.

A segmentation is a path over text positions whose steps are pieces.  For a
unigram model a step weighs the piece's score.  For a BPE model a step weighs
0 if the piece may follow the one before it, else minus infinity: two pieces
may stand side by side if merging their joined text ends in just these two, and
a sequence all of whose neighbours may is the one that merging the whole text
gives.  So the state at a position is, besides the position, the last piece
(BPE) or nothing more (unigram), and one recursion serves both.

A long text is cut into chunks at fixed places.  At a cut the possible states
are few: a piece that spans or ends at the cut, and how far it reaches past it.
Each chunk yields the matrix of best weights from every state at its start to
every state at its end; these combine associatively in the max-plus semiring;
a scan over a text's chunks fixes the state at every cut, after which each
chunk is traced back on its own.  A text of one chunk is the case of one
matrix.  Where no piece holds a space after another character, every word
start is a state of its own, and words that recur are looked up.
"""

from __future__ import annotations

import gc
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import texts
from .store import held, in_arrow, keep, parts, scratch, spare

#: Where the public vocabularies are; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and matrices that one step multiplies.
CHUNK, FAN = 65_536, 16
#: Words whose pieces a worker remembers, and bytes of text that it looks up at once.
MEMORY, STEP = 150_000, 2 << 20
#: Longer words are solved one by one.
WIDE = 48
META = "▁"
#: Marks a stretch that has no mark of its own before it; a text that holds it is solved whole.
BARE = "\x00"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_LOW = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message: int, bytes, or 4 raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and flags of a serialized SentencePiece model of type unigram or BPE without character normalization."""

    def __init__(self, data: bytes, kind: str | None = None):
        self.text, self.score, self.type = [], [], []
        self.kind, self.prefix, extra = "unigram", True, True
        charsmap = b""
        for key, value in _fields(data):
            if key == 1:
                got = dict(_fields(value))
                self.text.append(got.get(1, b"").decode())
                self.score.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.type.append(got.get(3, _NORMAL))
            elif key == 2:
                self.kind = {1: "unigram", 2: "bpe"}.get(dict(_fields(value)).get(3, 1), "other")
            elif key == 3:
                got = dict(_fields(value))
                charsmap, self.prefix, extra = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        self.kind = kind or self.kind
        if self.kind == "other" or charsmap or extra:
            raise ValueError("only unigram and BPE models that leave characters and spaces as they are")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.type, strict=True)) if k in (_NORMAL, _USER)}
        self.unknown = self.type.index(_UNKNOWN)
        self.bytes = {int(self.text[i][1:-1], 16): i for i, k in enumerate(self.type) if k == _BYTE}
        self.widest = max(map(len, self.ids), default=1)
        # a character of no piece stands alone, so texts can be cut there too
        self.breaks = not any("\n" in t for t in self.ids)
        self.bounded = not any(META in t.lstrip(META) for t in self.ids)
        self.lowest = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self._fits: dict[tuple[str, str], bool] = {}
        self._known: dict[str, bytes] = {}
        self._was: dict[str, bytes] = {}
        self.table = _Table(self) if self.kind == "bpe" else None
        shown = [self._shown(i) for i in range(len(self.text))]
        self.out_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.out_size = np.array([len(x) for x in shown], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size

    # -- weights -----------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of text by merging: the neighbours with the best joined piece first, leftmost of equals."""
        s = list(text)
        ids, score = self.ids, self.score
        while len(s) > 1:
            best, at = _LOW, -1
            for i in range(len(s) - 1):
                k = ids.get(s[i] + s[i + 1])
                if k is not None and score[k] > best:
                    best, at = score[k], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def fits(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 4 * MEMORY:
                self._fits.clear()
            got = self._fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def steps(self, text: str, at: int, end: int) -> Iterator[str]:
        """Pieces that start at a position; a character that is no piece stands for itself."""
        one = text[at : at + 1]
        if one:
            yield one
        for n in range(2, min(self.widest, end - at) + 1):
            if (t := text[at : at + n]) in self.ids:
                yield t

    # -- the recursion -----------------------------------------------------

    def walk(self, text: str, at: int, last: str | None, until: int) -> tuple[dict, dict]:
        """From one state, every state whose piece starts before `until`: weight, and the state before.

        A state is (position, piece); for a unigram model the piece is "" past
        the first step, so a position is one state.
        """
        bpe = self.kind == "bpe"
        first = (at, last)
        weight, back = {first: 0.0}, {first: None}
        by_place: dict[int, list] = {at: [first]}
        for p in range(at, until):
            here = by_place.get(p)
            if not here:
                continue
            for b in self.steps(text, p, len(text)):
                for s in here:
                    if bpe:
                        if not self.fits(s[1], b):
                            continue
                        w, key = weight[s], (p + len(b), b)
                    else:
                        k = self.ids.get(b)
                        w, key = weight[s] + (self.lowest if k is None else self.score[k]), (p + len(b), "")
                    had = weight.get(key)
                    if had is None or w > had:
                        weight[key] = w
                        back[key] = (s, b)
                        if had is None:
                            by_place.setdefault(key[0], []).append(key)
        return weight, back

    def trace(self, back: dict, state: tuple) -> list[str]:
        out = []
        while back[state] is not None:
            state, piece = back[state]
            out.append(piece)
        return out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for t in pieces:
            k = self.ids.get(t)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in t.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def recall(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids of stretches between two word starts, each given without its leading mark: one matrix, one state on either side."""
        known, was = self._known, self._was
        if len(known) + len(stretches) > MEMORY:
            known, was = {}, known
            self._known, self._was = known, was
        rest = []
        for t in stretches:
            if t not in known:
                got = was.get(t)
                if got is None:
                    rest.append(t)
                else:
                    known[t] = got
        if self.kind == "bpe":
            short = [t for t in rest if len(t) < WIDE and t != BARE]
            known.update(zip(short, self.table.solve([self.stretch(t) for t in short]), strict=True))
            rest = [t for t in rest if len(t) >= WIDE or t == BARE]
        for t in rest:
            known[t] = packed(self.numbers(self.best(self.stretch(t))))
        return known

    @staticmethod
    def stretch(t: str) -> str:
        return t[1:] if t[:1] == BARE else META + t

    def best(self, text: str) -> list[str]:
        if self.kind != "bpe" or len(text) > 64:
            weight, back = self.walk(text, 0, None, len(text))
            ends = [s for s in weight if s[0] == len(text)]
            return self.trace(back, max(ends, key=lambda s: weight[s]))
        # a prefix has one allowed path, so one piece a position is the whole state
        n, ids, fits = len(text), self.ids, self._fits
        last: list[str | None] = [None] * (n + 1)
        for p in range(1, n + 1):
            for q in range(max(0, p - self.widest), p):
                b = text[q:p]
                if b in ids or q == p - 1:
                    a = last[q]
                    ok = True if a is None else fits.get((a, b))
                    if ok or (ok is None and self.fits(a, b)):
                        last[p] = b
                        break
        out, p = [], n
        while p:
            out.append(last[p])
            p -= len(last[p])
        return out[::-1]

    def starts(self, text: str, at: int, end: int) -> int:
        """The first word start after `at` and before `end`, or -1."""
        if self.bounded:
            p = max(at, 1)
            while 0 <= (p := text.find(META, p)) < end:
                if text[p - 1] != META:
                    return p
                p += 1
        return -1

    def words(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that start and end at word starts."""
        if not self.bounded:
            return [packed(self.numbers(self.best(t)) if t else []) for t in texts]
        plain = [BARE not in t for t in texts]
        cut = META + BARE + "\n" + META + BARE
        lines = [(t.replace("\n", cut) if self.breaks else t).split(META) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        collecting = gc.isenabled()
        gc.disable()  # many small objects, and no cycles among them
        known = self.recall(set(chain.from_iterable(lines)))
        out = []
        for t, line in zip(texts, lines, strict=True):
            if not line:
                out.append(packed(self.numbers(self.best(t))))
            elif not line[0] and line.count("") == 1:
                out.append(b"".join(map(known.__getitem__, line[1:])))
            else:
                out.append(self.runs(line, known))
        if collecting:
            gc.enable()
        return out

    def runs(self, line: list[str], known: dict) -> bytes:
        """Ids of a text, cut at marks, that has runs of them or doesn't begin with one."""
        ids = [packed(self.numbers(self.best(line[0])))] if line[0] else []
        run, final = 1, len(line) - 1
        for i in range(1, len(line)):
            t = line[i]
            if not t and i < final:
                run += 1
                continue
            if run == 1:
                ids.append(known[t])
            elif t[:1] == BARE:
                ids.append(packed(self.numbers(self.best(META * (run - 1)))))
                ids.append(known[t])
            else:
                ids.append(packed(self.numbers(self.best(META * run + t))))
            run = 1
        return b"".join(ids)

    # -- chunks --------------------------------------------------------------

    def edge_states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """States at a cut: how far the last piece reaches past it, and that piece; in a fixed order."""
        found = set()
        for q in range(max(0, cut - self.widest), cut):
            for b in self.steps(text, q, len(text)):
                if q + len(b) >= cut:
                    found.add((q + len(b) - cut, b if self.kind == "bpe" else ""))
        return sorted(found)

    def matrix(self, text: str, start: int, stop: int, entries: list, final: bool) -> list[tuple]:
        """(state at start, state at stop, best weight) of a chunk; text has margins of the widest piece on both sides."""
        out = []
        sync = self.starts(text, start + self.widest, stop - self.widest)
        tail = self.starts(text, max(sync, stop - 2 * self.widest - 64), stop) if sync >= 0 else -1
        if sync >= 0:
            # all paths meet at word starts: the matrix is a column times a row, with the middle's weight between
            tail = tail if tail >= 0 else sync
            w, _ = self.walk(text, tail, None, stop)
            row = self._exits(w, tail, stop, final)
            middle = 0.0 if self.kind == "bpe" else self._weigh(text[sync:tail])
            for e in entries:
                got, _ = self.walk(text[:sync], start + e[0], e[1] if self.kind == "bpe" else "", sync)
                into = max((x for s, x in got.items() if s[0] == sync), default=None)
                if into is not None:
                    out.extend((e, to, into + middle + x) for to, x in row)
        else:
            for e in entries:
                got, _ = self.walk(text, start + e[0], e[1] if self.kind == "bpe" else "", stop)
                out.extend((e, to, x) for to, x in self._exits(got, start, stop, final))
        return out

    def _exits(self, weight: dict, start: int, stop: int, final: bool) -> list:
        if final:
            best = max((x for s, x in weight.items() if s[0] == stop), default=None)
            return [] if best is None else [((0, ""), best)]
        return [((p - stop, b if self.kind == "bpe" else ""), x) for (p, b), x in weight.items() if p >= stop]

    def _weigh(self, text: str) -> float:
        total, at = 0.0, 0
        while at < len(text):
            to = self.starts(text, at + 1, len(text))
            to = len(text) if to < 0 else to
            total += sum(self.lowest if (k := self.ids.get(t)) is None else self.score[k] for t in self.best(text[at:to]))
            at = to
        return total

    def between(self, text: str, start: int, stop: int, entry: tuple, leave: tuple, final: bool) -> list[int]:
        """Ids of a chunk whose states at both ends are known."""
        bpe = self.kind == "bpe"
        at = start + entry[0]
        first = entry[1] if bpe and entry[1] else None
        sync = self.starts(text, start + self.widest, stop - self.widest)
        head: list[str] = []
        if sync >= 0:
            w, back = self.walk(text[:sync], at, first, sync)
            head = self.trace(back, max((s for s in w if s[0] == sync), key=lambda s: w[s]))
            tail = self.starts(text, max(sync, stop - 2 * self.widest - 64), stop)
            tail = tail if tail >= 0 else sync
            ids = self.numbers(head) + unpacked(self.words([text[sync:tail]])[0])
            at, first = tail, None
        else:
            ids = []
        w, back = self.walk(text, at, first, stop)
        if final:
            ends = [s for s in w if s[0] == stop]
        else:
            ends = [s for s in w if s[0] == stop + leave[0] and (not bpe or s[1] == leave[1])]
        return ids + self.numbers(self.trace(back, max(ends, key=lambda s: w[s])))

    # -- text ------------------------------------------------------------------

    def prepared(self, text: str) -> str:
        return (META if self.prefix and text else "") + text.replace(" ", META)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.words([self.prepared(text)])[0])

    def _shown(self, i: int) -> bytes:
        k = self.type[i]
        if k == _BYTE:
            return bytes([int(self.text[i][1:-1], 16)])
        return b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else self.text[i].replace(META, " ").encode()

    def decode_flat(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that aren't UTF-8 become replacement characters."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        raw = self.out_bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.out_start[ids] - (ends - size), size)].tobytes()
        at = np.concatenate([[0], ends])[offs].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in out] if self.prefix else out

    def digest(self, ids: bytes) -> str:
        flat = np.frombuffer(ids, np.int32)
        return hashlib.sha256(self.decode_flat(flat, np.array([0, len(flat)]))[0].encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


class _Table:
    """The recursion of a BPE model for many words at once; words are rows, and steps go over all of them.

    Pieces are found by a polynomial hash of their characters, in a filter of
    bits and then a sorted array; pairs of pieces are kept in an open table
    with the answer of Model.fits.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.text)
        texts = list(model.ids)
        h = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            x = 0
            for c in t:
                x = (x * int(self.BASE) + self._char(ord(c))) & ((1 << 64) - 1)
            h[i] = x
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array([model.ids[t] for t in texts], np.int64)[order]
        self.bits = np.zeros(1 << 21, bool)
        self.bits[self.hash >> np.uint64(43)] = True
        self.width = np.array([len(t) for t in model.text], np.int64)
        self.keys = np.full(1 << 21, -1, np.int64)
        self.fit = np.zeros(1 << 21, bool)
        self.held = 0

    @staticmethod
    def _char(c: int) -> int:
        x = ((c + 1) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
        return x ^ (x >> 29)

    def _name(self, i: int) -> str:
        return self.model.text[i] if i < self.size else chr(i - self.size)

    def _place(self, key: np.ndarray) -> np.ndarray:
        x = key.view(np.uint64) * self.BASE
        return ((x ^ (x >> np.uint64(32))) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (1 << 22) + b
        at = self._place(key)
        out = np.zeros(len(key), bool)
        todo = np.arange(len(key))
        while len(todo):
            got = self.keys[at]
            hit = got == key[todo]
            out[todo[hit]] = self.fit[at[hit]]
            new = got == -1
            if new.any():
                fresh = np.unique(key[todo[new]])
                self._add(fresh)
                return self.fits(a, b)
            todo, at = todo[~hit], (at[~hit] + 1) & (len(self.keys) - 1)
        return out

    def _add(self, fresh: np.ndarray) -> None:
        if 2 * (self.held + len(fresh)) > len(self.keys):
            grow = max(len(self.keys), 1 << int(4 * len(fresh)).bit_length())
            self.keys, self.fit, self.held = np.full(grow, -1, np.int64), np.zeros(grow, bool), 0
        merge = self.model.merge
        mask = len(self.keys) - 1
        for key, at in zip(fresh.tolist(), self._place(fresh).tolist(), strict=True):
            a, b = self._name(key >> 22), self._name(key & ((1 << 22) - 1))
            while self.keys[at] != -1:
                at = (at + 1) & mask
            self.keys[at], self.fit[at] = key, merge(a + b) == [a, b]
        self.held += len(fresh)

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of each word; none is empty, all shorter than WIDE + 1."""
        if not words:
            return []
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        longest = len(words[order[0]])
        code = np.array([words[i] for i in order], dtype=f"U{longest}").view(np.uint32).reshape(len(words), longest)
        length = np.array([len(words[i]) for i in order], np.int64)
        rows = np.searchsorted(-length, -np.arange(longest + 1), side="right")  # rows at least so long
        x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = np.ascontiguousarray((x ^ (x >> np.uint64(29))).T)
        code = code.T
        last = np.full((longest + 1, len(words)), -1, np.int64)
        widest = self.model.widest
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for q in range(longest):
            h = np.zeros(rows[q + 1], np.uint64)
            for n in range(1, min(widest, longest - q) + 1):
                r = rows[q + n]
                if not r:
                    break
                h = h[:r] * self.BASE + mixed[q + n - 1, :r]
                maybe = np.flatnonzero(self.bits[h >> np.uint64(43)])
                at = np.searchsorted(self.hash, h[maybe])
                at[at == len(self.hash)] = 0
                ok = self.hash[at] == h[maybe]
                row, piece = maybe[ok], self.id[at[ok]]
                if n == 1 and len(row) < r:
                    alone = np.setdiff1d(np.arange(r), row)
                    row, piece = np.concatenate([row, alone]), np.concatenate([piece, code[q, alone].astype(np.int64) + self.size])
                if len(row):
                    found[q, n] = (row, piece)
        for p in range(1, longest + 1):
            for n in range(min(widest, p), 0, -1):
                got = found.pop((p - n, n), None)
                if got is None:
                    continue
                row, b = got
                if n < p:
                    free = last[p, row] < 0
                    row, b = row[free], b[free]
                    if not len(row):
                        continue
                    ok = self.fits(last[p - n, row], b)
                    row, b = row[ok], b[ok]
                last[p, row] = b
        steps, at = [], length.copy()
        every = np.arange(len(words))
        while (at > 0).any():
            live = at > 0
            b = np.where(live, last[at, every], -1)
            steps.append(b)
            at = at - np.where(live, np.where(b < self.size, self.width[np.minimum(np.maximum(b, 0), self.size - 1)], 1), 0)
        grid = np.ascontiguousarray(np.array(steps[::-1]).T.astype(np.int32))
        odd = np.flatnonzero((grid >= self.size).any(axis=1)).tolist()
        many, wide, raw = (grid >= 0).sum(axis=1).tolist(), grid.shape[1], grid.tobytes()
        out: list = [None] * len(words)
        for r, (i, n) in enumerate(zip(order, many, strict=True)):
            out[i] = raw[4 * ((r + 1) * wide - n) : 4 * (r + 1) * wide]
        for r in odd:
            out[order[r]] = packed(self.model.numbers([self._name(k) for k in grid[r].tolist() if k >= 0]))
        return out


def combine(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two matrices given as (from, to, weight); associative."""
    by: dict = {}
    for s, t, w in b:
        by.setdefault(tuple(s), []).append((tuple(t), w))
    out: dict = {}
    for s, m, w in a:
        for t, x in by.get(tuple(m), ()):
            key = (tuple(s), t)
            if w + x > out.get(key, _LOW):
                out[key] = w + x
    return [(s, t, w) for (s, t), w in out.items()]


def product(mats: list) -> list[tuple]:
    out = mats[0]
    for m in mats[1:]:
        out = combine(out, m)
    return out


def cuts(mats: list, first: tuple = (0, ""), last: tuple | None = None) -> list[tuple]:
    """The state at each of the n + 1 edges of n chunks on the best path from one state to another, or to the best one."""
    upto = [{first: 0.0}]
    for m in mats:
        new: dict = {}
        for s, t, w in m:
            s, t = tuple(s), tuple(t)
            if s in upto[-1] and upto[-1][s] + w > new.get(t, _LOW):
                new[t] = upto[-1][s] + w
        upto.append(new)
    state = last if last is not None else max(upto[-1], key=lambda s: (upto[-1][s], s))
    out = [state]
    for k in range(len(mats) - 1, 0, -1):
        into = upto[k]
        out.append(max((into[tuple(s)] + w, tuple(s)) for s, t, w in mats[k] if tuple(t) == out[-1] and tuple(s) in into)[1])
    return [first, *out[::-1]]


def _load(shared) -> Model:
    """One model a worker, so that its memory of words lasts over batches and tasks."""
    return held(shared.id, lambda: Model(*shared.value))


class _Shared:
    def __init__(self, spark, model_path: str, kind: str | None):
        with open(model_path, "rb") as f:
            data = f.read()
        self.id = hash((data, kind))
        Model(data, kind)
        self.b = spark.sparkContext.broadcast((data, kind))

    @property
    def value(self):
        return self.b.value


_CHUNKS = "doc long, k int, n int, text string, start int, stop int"


def _rows(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)


def _ids_array(lists: list[bytes], null: list[bool]) -> pa.Array:
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    mask = pa.array(null, pa.bool_()) if any(null) else None
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(lists), np.int32)), mask=mask)


_STATE, _WEIGHTS = "struct<j:int,b:string>", "array<struct<f:struct<j:int,b:string>,t:struct<j:int,b:string>,w:double>>"
_ST = pa.struct([("j", pa.int32()), ("b", pa.string())])
_MAT = pa.list_(pa.struct([("f", _ST), ("t", _ST), ("w", pa.float64())]))


def _two(s: dict) -> tuple:
    return s["j"], s["b"]


def _one(s: tuple) -> dict:
    return {"j": s[0], "b": s[1] or ""}


def _line(ms: list) -> list:
    """Matrices of a group in order of their places."""
    return [[(_two(x["f"]), _two(x["t"]), x["w"]) for x in y["m"]] for y in sorted(ms, key=lambda y: y["k"])]


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows.append((r["doc"], r["k"], [{"f": _one(f), "t": _one(t), "w": w} for f, t, w in product(_line(r["ms"]))]))
        yield _rows(["doc", "k", "m"], [pa.int64(), pa.int32(), _MAT], rows)


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["doc"], r["k"], *map(_one, cuts([_line([{"k": 0, "m": r["m"]}])[0]]))) for r in batch.to_pylist()]
        yield _rows(["doc", "k", "f", "t"], [pa.int64(), pa.int32(), _ST, _ST], rows)


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            edges = cuts(_line(r["ms"]), _two(r["f"]), _two(r["t"]))
            for i, k in enumerate(sorted(y["k"] for y in r["ms"])):
                rows.append((r["doc"], k, *map(_one, edges[i : i + 2])))
        yield _rows(["doc", "k", "f", "t"], [pa.int64(), pa.int32(), _ST, _ST], rows)


def scan(mats: DataFrame) -> DataFrame:
    """(doc, k, f, t): the states at both ends of each chunk on its text's best path, from all chunks' matrices (doc, k, m).

    Up a tree, FAN neighbours' matrices are multiplied into one; down it, a
    node's two states fix those between its children.  No task holds more than
    FAN matrices of a text.
    """

    def grouped(m: DataFrame) -> DataFrame:
        return m.groupBy("doc", F.floor(F.col("k") / FAN).cast("int").alias("g")).agg(F.collect_list(F.struct("k", "m")).alias("ms"))

    levels, width = [mats], (mats.agg(F.max("k")).first()[0] or 0) + 1
    while width > 1:
        up = in_arrow(grouped(levels[-1]).select("doc", F.col("g").alias("k"), "ms"), _multiply, f"doc long, k int, m {_WEIGHTS}")
        levels.append(keep(up, "products"))
        width = -(-width // FAN)
    edges = in_arrow(levels.pop(), _begin, f"doc long, k int, f {_STATE}, t {_STATE}")
    for m in reversed(levels):
        above = edges.select(F.col("doc").alias("_d"), F.col("k").alias("_k"), "f", "t")
        both = grouped(m).join(above, (F.col("doc") == F.col("_d")) & (F.col("g") == F.col("_k"))).select("doc", "ms", "f", "t")
        edges = keep(in_arrow(both, _divide, f"doc long, k int, f {_STATE}, t {_STATE}"), "cuts")
    return edges


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK, kind: str | None = None, back: bool = False) -> DataFrame:
    """docs with a column ids array<int>; all rows and columns stay.

    back adds decoded_sha256, of the text that the ids decode to, worked out
    in the same worker, so that ids needn't be sent out twice.

    A null text has null ids, an empty one none; repeated rows are encoded one
    by one; an empty table gives an empty one.  A text of more than `chunk`
    characters is cut; its chunks are spread over tasks, and only their small
    matrices meet.  Columns that are named ids or decoded_sha256 already are
    replaced by what is added, other names don't matter.  Rows come in no
    order; a column that says theirs comes through.
    """
    added = ["ids", "decoded_sha256"] if back else ["ids"]
    names = [n for n in docs.columns if n not in added]
    at = names.index("text")
    spark = docs.sparkSession
    shared = _Shared(spark, model_path, kind)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for part in texts(batches, step=STEP):
            some = part.column(at).to_pylist()
            ids = m.words([m.prepared(t or "") for t in some])
            cols = [*part.columns, _ids_array(ids, [t is None for t in some])]
            if back:
                cols.append(pa.array([None if t is None else m.digest(x) for t, x in zip(some, ids, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*names, *added])

    d = docs.select(*[docs[n] for n in names])
    is_short = F.coalesce(F.length("text"), F.lit(0)) <= chunk
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())][: len(added)]
    small = in_arrow(d.filter(is_short), short, T.StructType([*d.schema.fields, *more]), model=True)

    # long texts: a key for each, so that repeated ids and rows stay apart
    row = F.struct(*[d[n] for n in names]).alias("row")
    long_ = keep(d.filter(~is_short).select(row, F.monotonically_increasing_id().alias("doc")), "long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        pad = m.widest
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = m.prepared(text)
                n = -(-len(text) // chunk)
                for k in range(n):
                    a, b = k * chunk, min(len(text), (k + 1) * chunk)
                    lo, hi = max(0, a - pad), min(len(text), b + pad)
                    yield _rows(
                        ["doc", "k", "n", "text", "start", "stop"],
                        [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()],
                        [(doc, k, n, text[lo:hi], a - lo, b - lo)],
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                entries = [(0, None)] if r["k"] == 0 else m.edge_states(r["text"], r["start"])
                got = m.matrix(r["text"], r["start"], r["stop"], entries, r["k"] == r["n"] - 1)
                rows.append((r["doc"], r["k"], [{"f": _one(f), "t": _one(t), "w": w} for f, t, w in got]))
            yield _rows(["doc", "k", "m"], [pa.int64(), pa.int32(), _MAT], rows)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = m.between(r["text"], r["start"], r["stop"], _two(r["f"]), _two(r["t"]), r["k"] == r["n"] - 1)
                rows.append((r["doc"], r["k"], ids))
            yield _rows(["doc", "k", "ids"], [pa.int64(), pa.int32(), pa.list_(pa.int32())], rows)

    with scratch(spark):
        chunks = in_arrow(long_.select("doc", "row.text"), split, _CHUNKS, model=True).repartition(max(parts(spark), 1), "doc", "k")
        chunks = keep(chunks, "chunks")
        known = scan(keep(in_arrow(chunks, matrices, f"doc long, k int, m {_WEIGHTS}", model=True), "matrices"))
        known = known.select(F.col("doc").alias("_d"), F.col("k").alias("_k"), "f", "t")
        both = chunks.join(known, (F.col("doc") == F.col("_d")) & (F.col("k") == F.col("_k"))).select("doc", "k", "n", "text", "start", "stop", "f", "t")
        got = in_arrow(both, traced, "doc long, k int, ids array<int>", model=True)
        got = got.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("s"))
        got = keep(got.select(F.col("doc").alias("_d"), F.flatten(F.transform("s", lambda x: x.ids)).alias("ids")), "ids", last=True)
    large = long_.join(got, F.col("doc") == F.col("_d")).select(*[F.col("row")[n].alias(n) for n in names], "ids")
    if back:
        (twin,) = spare(large, "twin")
        large = decode(large.withColumn(twin, F.col("ids")), model_path, kind, out="decoded_sha256", named=twin)
        large = large.withColumn("decoded_sha256", F.sha2(F.encode("decoded_sha256", "UTF-8"), 256))
    return small.unionAll(large.select(*names, *added))


def decode(encoded: DataFrame, model_path: str = MODEL, kind: str | None = None, out: str = "text", named: str = "ids") -> DataFrame:
    """encoded with the column `named` replaced by the column `out`: the text of the ids; null for null ids."""
    names = [n for n in encoded.columns if n not in (named, out)]
    shared = _Shared(encoded.sparkSession, model_path, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                col = part.column(0)
                size = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
                texts = m.decode_flat(col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]))
                texts = [t if ok else None for t, ok in zip(texts, col.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], [*names, out])

    (of,) = spare(encoded, "of")
    e = encoded.select(encoded[named].alias(of), *[encoded[n] for n in names])
    return in_arrow(e, run, T.StructType([*encoded.select(*names).schema.fields, T.StructField(out, T.StringType())]), model=True)


def op1_max_plus_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = encode(docs, back=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "decoded_sha256")
