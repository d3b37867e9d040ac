"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words.  Every passage is encoded
as frequencies of byte-class pairs and of repeated words, and projected by a
learned layer; gated attention weights, learned from document labels alone,
make the bag's representation, which a logistic unit scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, buffers, texts
from .store import in_arrow

PASSAGE_WORDS = 48
#: Bounds of the training sample: labelled documents, and passages of each, spread evenly over it.
SAMPLE_DOCS, SAMPLE_PASSAGES = 3000, 64
#: Passages whose bytes are counted at once.
BLOCK = 1 << 12
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 250, 0.02, 1e-4, 11
THRESHOLD = 0.3

#: Byte classes: A-Z, a-z, digits, space, line break, sentence marks, other ASCII, bytes of non-ASCII characters.
_CLASS = np.full(256, 6, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
FEATURES = 64 + 4


def encode(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the bounds of each row's passages; a row without words has one, of zeros."""
    w = Words(raw, offs)
    n = np.diff(w.first)
    per = np.maximum((n + PASSAGE_WORDS - 1) // PASSAGE_WORDS, 1)
    bound = np.concatenate([[0], np.cumsum(per)])
    x = np.zeros((bound[-1], FEATURES), np.float32)
    if len(w):
        place = bound[w.doc] + (np.arange(len(w)) - w.first[w.doc]) // PASSAGE_WORDS
        # a passage owns the bytes from its first word to the next passage's first word
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ids = place[head]
        start, row = w.start[head], w.doc[head]
        end = np.minimum(np.concatenate([start[1:], [len(raw)]]), offs[row + 1])
        size = end - start
        for i in range(0, len(ids), BLOCK):
            some = size[i : i + BLOCK]
            owner = np.repeat(np.arange(len(some)), some)
            at = np.arange(len(owner)) + np.repeat(start[i : i + BLOCK] - (np.cumsum(some) - some), some)
            pair = _CLASS[raw[at]] * 8 + _CLASS[raw[np.minimum(at + 1, len(raw) - 1)]]
            got = np.bincount(owner * 64 + pair, minlength=len(some) * 64).reshape(-1, 64)
            x[ids[i : i + BLOCK], :64] = got / some[:, None]
        words = np.bincount(place, minlength=bound[-1])
        h = w.hashes()
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (place[1:] == place[:-1])
        by = np.lexsort((h, place))
        dup = np.zeros(len(h), bool)
        dup[1:] = (h[by][1:] == h[by][:-1]) & (place[by][1:] == place[by][:-1])
        some = np.maximum(words, 1)
        x[:, 64] = np.bincount(place, again, bound[-1]) / some
        x[:, 65] = np.bincount(place[by], dup, bound[-1]) / some
        x[:, 66] = np.minimum(np.bincount(place, w.end - w.start, bound[-1]) / some / 20, 2)
        x[:, 67] = words / PASSAGE_WORDS
    return np.sqrt(x), bound


class Attention:
    """Gated attention over passages: a = softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = mean, scale
        self.p = {
            "E": make(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE),
            "w": make(GATE, 1), "c": make(HIDDEN, 1), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bound: np.ndarray) -> tuple:
        p, at = self.p, bound[:-1]
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = ((t * s) @ p["w"]).ravel()
        size = np.diff(bound)
        ex = np.exp(g - np.repeat(np.maximum.reduceat(g, at), size))
        a = ex / np.repeat(np.add.reduceat(ex, at), size)
        bag = np.add.reduceat(a[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip((bag @ p["c"]).ravel() + p["d"], -30, 30)))
        return y, (z, h, t, s, a, bag, size)

    def gradient(self, x: np.ndarray, bound: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the bags' labels, by parameter."""
        p = self.p
        y, (z, h, t, s, a, bag, size) = self.forward(x, bound)
        dy = (y - label)[:, None] / len(label)
        dbag = np.repeat(dy @ p["c"].T, size, axis=0)
        da = (dbag * h).sum(axis=1)
        dg = a * (da - np.repeat(np.add.reduceat(a * da, bound[:-1]), size))
        dts = dg[:, None] @ p["w"].T
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dbag + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {
            "E": z.T @ du, "e": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
            "w": (t * s).T @ dg[:, None], "c": bag.T @ dy, "d": dy.sum(axis=0),
        }

    def fit(self, x: np.ndarray, bound: np.ndarray, label: np.ndarray) -> None:
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            p = self.p
            for k, v in self.gradient(x, bound, label).items():
                v = v + DECAY * p[k]
                m[k][0] = 0.9 * m[k][0] + 0.1 * v
                m[k][1] = 0.999 * m[k][1] + 0.001 * v * v
                p[k] = p[k] - RATE * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self.forward(x, bound)[0]


def _held(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Attention | float:
    """A model from the labelled rows of docs, by a bounded sample; a constant score if fewer than two classes are there.

    labels: (doc_id, quality); rows with null in either take no part, and of
    rows that repeat a doc_id one counts.  A document of more than
    SAMPLE_PASSAGES passages lends so many, evenly spread over all of it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("_id IS NOT NULL AND label IS NOT NULL").filter(~_held("_id"))
    # at most SAMPLE_DOCS short rows: the broadcast below is bounded by that
    drawn = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(SAMPLE_DOCS).groupBy("_id").agg(F.min("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches):
            x, bound = encode(*buffers(part.column(2)))
            lists = []
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                some = x[a:b] if b - a <= SAMPLE_PASSAGES else x[a + np.arange(SAMPLE_PASSAGES) * (b - a) // SAMPLE_PASSAGES]
                lists.append(some.astype(np.float32).ravel().tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.binary())], ["id", "label", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    rows = in_arrow(rows.select("doc_id", "label", "text"), run, "id long, label int, x binary")
    # of rows that repeat an id the least by content: SAMPLE_DOCS rows come to the driver at most
    got = {r.id: r for r in rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("s")).select("id", "s.*").collect()}
    bags = [np.frombuffer(got[i].x, np.float32).reshape(-1, FEATURES) for i in sorted(got)]
    label = np.array([float(got[i].label > 0) for i in sorted(got)])
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    x = np.concatenate(bags).astype(np.float64)
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    model.fit(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]), label)
    return model


def assess(docs: DataFrame, model: Attention | float) -> DataFrame:
    """(doc_id, score) for every row; a null text scores as an empty one, a bag of one passage without words.

    Repeated rows are scored one by one; an empty table gives an empty one;
    other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in texts(batches):
            score = np.full(part.num_rows, m) if isinstance(m, float) else m.score(*encode(*buffers(part.column(1))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def op5_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = assess(docs, fit(docs, labels))
    return got.select("doc_id", _held().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
