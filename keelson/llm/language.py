"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
parsed greedily into the longest phrases that the automaton knows; the language
that needs the fewest phrases, normalised by the logarithm of its training
size, wins.  The automata work on bytes (letters A-Z lower-cased, other ASCII
characters folded into one symbol), so any script fits, and become dense
transition tables: a byte costs one look-up for each language, for thousands of
segments of texts at once.  Segments of SEGMENT bytes are parsed side by side,
each from the state that the one before it in its text ends in.  That state is
guessed first, from the segment's last TAIL bytes, as parses from different
states soon break at the same places; segments whose guess was wrong are parsed
anew until none is, so the parse is that of the whole text from left to right.

Only the samples travel; each worker builds the automata once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_sum
from .kernel import buffers, texts
from .store import held, in_arrow, keep, scratch, spare

#: Bounds of the sample that the automata are built from: rows drawn and bytes used for each language, and the longest text drawn.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TEXT = 150, 32_768, 16_384
#: All languages are learned; past this many the rows (LEAST_ROWS at least) and bytes of each shrink.
FULL_LANGS, LEAST_ROWS = 64, 20
#: Bytes of all languages' tables together, which every worker holds; each language's sample shrinks until they fit.
TABLE_BYTES = 96 << 20
SEGMENT, TAIL = 256, 128
#: Bytes of symbols that a worker parses at once.
GRID_BYTES = 4 << 20
#: A text that breaks off MARGIN times more phrases a byte in its best language than held-out text of the
#: learned ones does (its QUANTILE), and SLACK phrases besides, is in none of them; SLACK is for a name or
#: key in a short text (one of 20 letters costs about 5).  MAX_RATE holds where there is no held-out text.
QUANTILE, MARGIN, SLACK, MAX_RATE = 0.99, 1.5, 6, 0.5
LETTER = r"\p{L}"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of data; state 0 is the start."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = cur
    return go


class Model:
    """Dense tables of the automata. langs: names in code-point order; bits: logarithm of each training size."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples, self.langs = samples, sorted(samples)
        folded = {k: _FOLD[np.frombuffer(v, np.uint8)] for k, v in samples.items()}
        used = sorted(set().union(*[set(np.unique(v).tolist()) for v in folded.values()])) if folded else []
        # code 0: a byte that no sample has; the last code: past the end of a segment
        self.shift = max(1, math.ceil(math.log2(len(used) + 2)))
        self.pad = (1 << self.shift) - 1
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, len(used) + 1)
        self.lut = code[_FOLD]
        self.tables, self.bits = [], []
        for k in self.langs:
            go = automaton(code[folded[k]].tobytes())
            # the last state follows a byte that the sample doesn't have: a phrase by itself, after which another begins
            lost = len(go)
            root = np.full(1 << self.shift, lost << self.shift, np.int32)
            for c, to in go[0].items():
                root[c] = to << self.shift
            t = np.tile(root | 1, (lost + 1, 1))
            for s, edges in enumerate(go):
                for c, to in edges.items():
                    t[s, c] = to << self.shift
            t[:, self.pad] = np.arange(lost + 1) << self.shift
            self.tables.append(t.ravel())
            self.bits.append(math.log2(max(2, len(samples[k]))))

    def _parse(self, t: np.ndarray, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the steps of grid, one row a step, and breaks on the way, from the given states."""
        v, count, clear = state.astype(np.int32), np.zeros(len(state), np.int32), np.int32(~self.pad)
        for step in grid:
            np.bitwise_and(v, clear, out=v)
            np.add(v, step, out=v)
            v = t.take(v)
            count += v & 1
        return v & clear, count

    def phrases(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases that each row needs in each language; shape (rows, languages)."""
        size = np.diff(offs)
        segs = (size + SEGMENT - 1) // SEGMENT
        out = np.zeros((len(size), len(self.langs)), np.int64)
        # long texts are taken in runs of segments, so that the grid of their symbols stays small
        most = max(1, GRID_BYTES // (4 * SEGMENT))
        last = np.cumsum(segs)
        lo = 0
        carry: list = [None] * len(self.langs)
        while lo < (last[-1] if len(last) else 0):
            hi = min(lo + most, int(last[-1]))
            seg = np.arange(lo, hi)
            row = np.searchsorted(last, seg, side="right")
            self._run(raw, offs, row, seg - (last - segs)[row], carry, out)
            lo = hi
        return out

    def _run(self, raw: np.ndarray, offs: np.ndarray, row: np.ndarray, nth: np.ndarray, carry: list, out: np.ndarray) -> None:
        """Adds the phrases of consecutive segments; carry has each language's state where the run before ended."""
        at = offs[:-1][row] + nth * SEGMENT
        end = offs[1:][row]
        lo, hi = int(at[0]), int(min(at[-1] + SEGMENT, len(raw)))
        codes = np.concatenate([self.lut[raw[lo:hi]], np.full(SEGMENT, self.pad, np.uint8)])
        grid = np.lib.stride_tricks.sliding_window_view(codes, SEGMENT)[at - lo].T.astype(np.int32)
        short = np.flatnonzero(end - at < SEGMENT)
        past = np.arange(SEGMENT)[:, None] >= (end - at)[short][None, :]
        grid[:, short] = np.where(past, self.pad, grid[:, short])
        inner = np.flatnonzero(nth[1:] > 0) + 1  # segments that go on with the one before
        for i, t in enumerate(self.tables):
            state = np.zeros(len(row), np.int32)
            if nth[0]:
                state[0] = carry[i]
            if len(inner):
                state[inner] = self._parse(t, grid[SEGMENT - TAIL :, inner - 1], np.zeros(len(inner), np.int32))[0]
            after, count = self._parse(t, grid, state)
            while len(wrong := inner[after[inner - 1] != state[inner]]):
                state[wrong] = after[wrong - 1]
                after[wrong], count[wrong] = self._parse(t, grid[:, wrong], state[wrong])
            carry[i] = after[-1]
            # a text's first phrase begins without a break, but for a byte that no sample has
            np.add.at(out[:, i], row, count + ((nth == 0) & (t.take(grid[0]) & 1 == 0)))

    def predict(self, raw: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, score and best rate of each row."""
        size = np.maximum(np.diff(offs), 1)
        n = len(size)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n)
        p = self.phrases(raw, offs)
        need = p * np.array(self.bits)
        best = need.argmin(axis=1)
        low = need[np.arange(n), best]
        if len(self.langs) > 1:
            second = np.partition(need, 1, axis=1)[:, 1]
            score = np.where(second > 0, 1 - low / np.maximum(second, 1e-9), 0)
        else:
            score = np.ones(n)
        lang = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return lang, np.where(letters, score, 0.0), np.maximum(p[np.arange(n), best] - 1, 0) / size


def _load(samples: dict[str, bytes]) -> Model:
    """One model a worker."""
    return held(hash(tuple(sorted(samples.items()))), lambda: Model(samples))


def _held(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame) -> list:
    """Rows (lang, text) for every language of docs (doc_id, text, lang), a bounded number each, by ascending id hash.

    Only rows with a language, an id and a text take part.  A language's texts
    are its ones of at most SAMPLE_TEXT bytes or, if it has none, beginnings of
    longer ones.
    """
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND octet_length(text) > 0")
    short = F.octet_length("text") <= SAMPLE_TEXT
    n = {r.lang: (r.short, r.all) for r in rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("short"), F.count("*").alias("all")).collect()}
    share = max(1.0, len(n) / FULL_LANGS)
    most, size = max(LEAST_ROWS, int(SAMPLE_ROWS / share)), int(SAMPLE_TEXT / share)
    grain, got, left = 1 << 30, [], dict(n)
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(grain))
    # the second draw is for languages whose ids happen to hash past the first one's bound
    for draw in (2 * most, math.inf):
        if not left:
            break
        bound = [(k, math.ceil(grain * min(1.0, draw / (a or b))), a > 0) for k, (a, b) in left.items()]
        bound = docs.sparkSession.createDataFrame(bound, "_lang string, _bound long, _short boolean")
        drawn = rows.join(F.broadcast(bound), (F.col("lang") == F.col("_lang")) & (hash_ < F.col("_bound")) & (short | ~F.col("_short")))
        # a character has at most four bytes
        text = F.col("text") if share == 1 else F.substring("text", 1, size)
        text = F.when(short, text).otherwise(F.substring("text", 1, min(size, SAMPLE_TEXT // 4)))
        drawn = drawn.select("lang", hash_.alias("_h"), text.alias("text"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
        got += drawn.withColumn("_n", place).filter(F.col("_n") <= 4 * most).orderBy("_h", "lang", "text").select("lang", "text").collect()
        left = {k: v for k, v in left.items() if k not in {r.lang for r in got}}
    return got


def chosen(rows: list) -> dict[str, bytes]:
    """Text of each language from rows (lang, text), up to SAMPLE_BYTES or what its part of TABLE_BYTES holds."""
    folded = np.unique(_FOLD[np.frombuffer("".join(r.text for r in rows).encode(), np.uint8)])
    # an automaton has at most two states a byte, and a state one int32 for each symbol
    wide = 4 << max(1, math.ceil(math.log2(len(folded) + 2)))
    most = min(SAMPLE_BYTES, TABLE_BYTES // (2 * wide * max(1, len({r.lang for r in rows}))))
    samples: dict[str, bytes] = {}
    for r in rows:
        b, have = r.text.encode(), samples.get(r.lang, b"")
        if len(have) + len(b) <= most or not have:
            samples[r.lang] = have + b[:most].decode("utf-8", "ignore").encode() + b"\n"
    return samples


def fit(docs: DataFrame) -> Model:
    """Automata of all languages of docs (doc_id, text, lang), each from what is chosen() of its sample()."""
    return Model(chosen(sample(docs)))


def _judged(docs: DataFrame, samples: dict[str, bytes], text: str, ok: str):
    """A worker's loop over docs: each slice with its rows' languages, scores and rates; text and ok: columns of text and of whether it has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    at, has = docs.columns.index(text), docs.columns.index(ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        model = _load(shared.value)
        for part in texts(batches, text):
            letters = part.column(has).to_numpy(zero_copy_only=False).astype(bool)
            yield part, *model.predict(*buffers(part.column(at)), letters)

    return run


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rate) for every row of docs, by automata of train.

    lang_pred is `und`, with score 0, where the text is null or has no letter,
    and everywhere if train has no labelled text; ties go to the first language
    by code point.  score is one less the best language's need over the
    second's (1 if there is one language); rate is phrases a byte in the best,
    without the first.  Repeated rows are judged one by one; other columns of
    docs are not read.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("ok"))
    judged = _judged(small, fit(train).samples, "text", "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lang, score, rate in judged(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "rate"])

    return in_arrow(small, run, "doc_id long, lang_pred string, score double, rate double", model=True)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(~_held())


def most_rate(model: Model, held: DataFrame) -> float:
    """Phrases a byte up to which a text is in a learned language, by all held-out rows (doc_id, text, lang) of such.

    The quantile is exact, whole texts and every row counting: distinct rates
    and their numbers are summed along their order, and no task gets them all.
    """
    rows = held.filter(F.col("lang").isin(model.langs) & F.col("text").rlike(LETTER)).select("text", F.lit(True).alias("ok"))
    judged = _judged(rows, model.samples, "text", "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, rate in judged(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rate)], ["rate"])

    with scratch(held.sparkSession):
        rates = keep(in_arrow(rows, run, "rate double", model=True).groupBy("rate").agg(F.count("*").alias("n")), "rates")
        n = rates.agg(F.sum("n")).first()[0]
        if not n:
            return MAX_RATE
        at = QUANTILE * (n - 1)
        k = int(at)
        # the value of place k, from 0, is the first that more than k rows come up to
        upto = with_sum(rates, ["rate"], "n", "upto")
        pair = upto.agg(*[F.min(F.when(F.col("upto") > i, F.col("rate"))) for i in (k, min(k + 1, n - 1))]).first()
    return MARGIN * float(np.quantile([*pair], at - k))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that are in no learned language: no letter, or too many phrases a byte.

    Null, empty and letterless texts go; without labelled text all rows go.
    Repeated rows are judged one by one, and columns stay as they are, whatever
    their names; nothing is shuffled; an empty table gives an empty one.
    """
    names, schema = docs.columns, docs.schema
    model = fit(training_rows(docs))
    most = most_rate(model, docs.select("doc_id", "text", "lang").filter(_held()))
    (ok,) = spare(docs, "ok")
    docs = docs.withColumn(ok, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    judged = _judged(docs, model.samples, "text", ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lang, _, rate in judged(batches):
            size = np.diff(buffers(part.column(names.index("text")))[1])
            fine = np.array([x != "und" for x in lang], bool) & (rate <= most + SLACK / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays(part.columns[: len(names)], names).filter(pa.array(fine))

    return in_arrow(docs, run, schema, model=True)


def op3_cross_parsing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs, training_rows(docs))
    return got.select("doc_id", _held().alias("held_out"), "lang_pred", "score", "rate")
