"""Odd names, empty tables, very long texts, and brute force for what test_operators.py leaves out."""

import hashlib
import math
import random
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import copies, fingerprint, kernel, language, mixing, pieces, quality, rules, simhash, substrings, urls, warc
from keelson.llm.kernel import buffers
from keelson.llm.store import fresh, spare
from tests.llm.test_operators import SF, odd_rows, words

#: Names that operators use, or have used, for columns of their own.
CLASH = ["gone", "_gone", "of", "hs", "__hs", "__text", "ok", "__ok", "num", "at", "n", "size", "again", "twin", "row", "doc", "k", "h", "c", "fp", "x", "p", "_doc", "_id", "position", "taken"]


def table(spark, rows=None, more=CLASH):
    rows = odd_rows() if rows is None else rows
    rows = [(*r[:5], *[f"{n}{i}" for n in more]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{n}` string" for n in more]]))


STAGES = {
    "identified": language.keep_identified,
    "representatives": copies.keep_representatives,
    "cut": substrings.cut_documents,
    "mixed": mixing.mixed,
    "encoded": lambda d: pieces.encode(d, chunk=97).drop("ids"),
    "placed": lambda d: mixing.placed(d, "place").drop("place"),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, name):
    """Extra columns come through with their rows, whatever their names; the rest is as without them."""
    stage, full, plain = STAGES[name], table(spark), table(spark, more=[])
    got = stage(full)
    assert got.columns == full.columns and got.schema == full.schema
    key = lambda rows: sorted(str((r.doc_id, r.text)) for r in rows)
    rows = got.collect()
    assert key(rows) == key(stage(plain).collect())
    was = {tuple(r[n] for n in CLASH) for r in full.collect()}
    assert all(tuple(r[n] for n in CLASH) in was for r in rows)
    if name in ("identified", "representatives", "encoded"):
        assert len({r["gone"] for r in rows}) == len(rows)
    empty = stage(full.limit(0))
    assert empty.columns == full.columns and empty.count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_texts_all_null_or_equal(spark, name):
    for text in (None, "", "the same few words in every row of it"):
        rows = STAGES[name](table(spark, [(i, text, "en", None, 0) for i in range(6)], [])).collect()
        if name == "representatives":
            assert [r.doc_id for r in rows] == [0]
        elif name in ("cut", "encoded", "placed"):
            assert sorted(r.doc_id for r in rows) == [*range(6)] and {r.text for r in rows} <= {text, ""}
        elif name == "mixed":
            assert len(rows) == (9 if text else 0)
        else:
            assert len(rows) in (0, 6) and (text or not rows)


def test_queries_read_no_other_columns(spark):
    full, plain = table(spark), table(spark, more=[])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    for f in (
        simhash.near_duplicates, copies.near_copies, substrings.digests, rules.assess, fingerprint.compare_edited, mixing.allot,
        lambda d: language.identify(d, d), lambda d: quality.assess(d, quality.fit(d, labels)), lambda d: pieces.encode(d, chunk=97, back=True).select("doc_id", "text", "ids", "decoded_sha256"),
    ):
        assert sorted(map(str, f(full).collect())) == sorted(map(str, f(plain).collect()))
        assert f(full.limit(0)).count() == 0


def test_pages_of_any_kind(spark):
    data = [(1, "http://casino-win.example.edu/", "a" * 120), (1, "http://casino-win.example.edu/", "a" * 120), (None, None, None), (2, "", ""), (3, "x" * 100_000, "a" * 120)]
    pages = spark.createDataFrame([(*r, "e", "f", "g") for r in data], "page_id long, url string, html string, host string, digest string, original string")
    got = sorted(((r.page_id, r.host, r.verdict) for r in urls.judge(pages).collect()), key=str)
    assert got == sorted([(1, "casino-win.example.edu", "block")] * 2 + [(None, "", "allow"), (2, "", "allow"), (3, "", "allow")], key=str)
    assert urls.judge(pages.limit(0)).count() == 0
    for kind in ("gzip", "none"):
        at = fresh(spark, "warc")
        warc.write(pages, at, kind)
        rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, at).collect()), key=str)
        assert rows == sorted([(1, "response", None)] * 2 + [(None, "response", None), (2, "response", None), (3, "revisit", 1)], key=str)


def test_vocabulary_decides_where_no_rule_does(spark):
    """Compounds that the list doesn't have as such are blocked; clean urls with one of their words aren't."""
    bad = ["cheap-meds.shop.edu", "poker-bonus.win-cash.edu", "adult-webcam.edu", "torrents.cracked.edu", "payday-loans.edu", "ads.tracker.edu", "replica-sale.wholesale.edu", "pills.discount.edu"]
    good = ["adult-education.edu", "free-library.edu", "tracking.parcels.edu", "farm.example.edu", "pharmacy.school.edu", "poker-face.edu", "bettings.casinox.edu", "hotel.edu/deals", "download.python.edu"]
    pages = spark.createDataFrame([(i, f"https://{u}/p?ref=x") for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(bad))] == [(None, "block")] * len(bad)
    assert [got[i] for i in range(len(bad), len(got))] == [(None, "allow")] * len(good)
    every = urls.op8_url_vocabulary(spark, "/root/testdata/sf0.01").filter("rule IS NULL")
    spam = F.col("host").rlike("casino|bets|spam|pills|adult|ads-")
    assert every.filter(spam & (F.col("verdict") == "allow")).count() == 0 == every.filter(~spam & (F.col("verdict") == "block")).count()
    assert every.filter("verdict = 'block'").count() > 0


def test_positions_invert_the_integral_of_the_schedule(spark):
    """A copy is due when the part of its source's weight that has passed is the part of its target before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.allot(docs).collect()
    place = {s: i for i, s in enumerate(sorted({r.source for r in rows}, key=lambda s: (s is None, s)))}

    def passed(t, ramp, steps=400):
        a, b = ramp
        mid = lambda i, upto: a + (b - a) * upto * (i + 0.5) / steps
        return sum(mid(i, t) for i in range(steps)) * t / steps / ((a + b) / 2)

    for source, i in place.items():
        mine = [r for r in rows if r.source == source]
        goal = math.floor(mine[0].target + 1e-6)
        order = sorted([(r.position, r.first_words) for r in mine if r.first_words] + [(r.again_position, r.again_words) for r in mine if r.again_words])
        before = 0
        for t, n in order:
            assert abs(passed(t, mixing.RAMPS[i % 3]) - before / goal) < 1e-9
            before += n
        assert before == goal
    texts = [r.text for r in mixing.mixed(docs).collect()]
    want = sorted([(r.position, r.doc_id, r.first_words) for r in rows if r.first_words] + [(r.again_position, r.doc_id, r.again_words) for r in rows if r.again_words])
    assert [len(words(t)) for t in texts] == [n for *_, n in want]


@pytest.mark.parametrize("sizes", [[100, 1, 1, 1, 900], [5], [0, 0], [10, 0, 7, 3, 3, 3, 3], list(range(1, 40))])
def test_targets_by_the_rule(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = sorted(f"s{i:02}" for i in range(1, len(sizes))) + [None]
    size = {(f"s{i:02}" if i else None): n for i, n in enumerate(sizes)}
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    full: set = set()
    while True:
        free = [s for s in names if s not in full]
        level = (Fraction(3, 2) * sum(sizes) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert abs(got[s] - float(2 * size[s] if s in full else weight[s] * level)) < 1e-9 * max(1, sum(sizes))


@pytest.mark.parametrize("fan", [2, 16])
def test_long_texts_decode_back_over_a_tree_of_chunks(spark, monkeypatch, fan):
    import sentencepiece

    monkeypatch.setattr(pieces, "FAN", fan)
    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdeé漢th \n") for _ in range(n)) for n in (700, 1500, 40)] + ["word " * 400, "", None, "▁" * 300, "a" * 900]
    rows = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pieces.encode(rows, chunk=61, back=True).collect()
    assert sorted(map(str, (r.text for r in got))) == sorted(map(str, texts))
    for r in got:
        if r.text is None:
            assert r.ids is None and r.decoded_sha256 is None
        else:
            assert r.ids == p.encode(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.replace("▁", " ").encode()).hexdigest()


def phrases(data: bytes, text: bytes) -> int:
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in data:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("grid", [16 << 20, 2 * 4 * language.SEGMENT])
def test_texts_are_parsed_over_the_bounds_of_segments(monkeypatch, grid):
    """Also where the parses of a segment from two states never meet, and where a text spans steps of a worker."""
    monkeypatch.setattr(language, "GRID_BYTES", grid)
    rng = random.Random(3)
    voc = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    samples = {"x": " ".join(rng.choice(voc[:60]) for _ in range(3000)).encode(), "y": " ".join(rng.choice(voc[20:]) for _ in range(3000)).encode(), "z": b"ab" * 300}
    model = language.Model(samples)
    texts = [" ".join(rng.choice(voc) for _ in range(n)) for n in (0, 1, 5, 60, 500, 1500)] + ["Q" * 700, "ab" * 2000, "b" + "ab" * 900 + "c" * 9, "ab" * 128, "a"]
    fold = lambda b: model.lut[np.frombuffer(b, np.uint8)].tobytes()
    want = [[phrases(fold(samples[k]), fold(t.encode())) for k in model.langs] for t in texts]
    assert model.phrases(*buffers(pa.array(texts))).tolist() == want


def test_languages_of_long_texts_only_and_tables_that_fit(spark, monkeypatch):
    rng = random.Random(4)
    voc = {k: ["".join(rng.choice(c) for _ in range(rng.randint(3, 8))) for _ in range(80)] for k, c in (("aa", "abcdefgh"), ("bb", "efghijkl"))}
    say = lambda k, n: " ".join(rng.choice(voc[k]) for _ in range(n))
    rows = [(i, say("aa", 6000), "aa") for i in range(10)] + [(100 + i, say("bb", 40), "bb") for i in range(40)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (language.TABLE_BYTES, 1 << 19):
        monkeypatch.setattr(language, "TABLE_BYTES", most)
        assert {r.doc_id: r.lang_pred for r in language.identify(t, t).collect()} == {i: k for i, _, k in rows}
        assert sum(x.nbytes for x in language.fit(t).tables) <= most


def test_the_rejection_rate_counts_every_held_out_text_as_a_whole(spark):
    """More rows than a sample has, long texts and copies, against the quantile of rates that are taken row by row."""
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    learned = [(i, say(40), "aa") for i in range(60)]
    rows = [(1000 + i, say(rng.randint(1, 30)) + noise(rng.randint(0, 40)), "aa") for i in range(1500)]
    rows += [(3000 + i, noise(17_000 + i), "aa") for i in range(12)] + [(4000 + i, rows[0][1], "aa") for i in range(300)]
    other = [(5000, noise(90), "zz"), (5001, noise(90), None), (5002, None, "aa"), (5003, "", "aa"), (5004, "12 34", "aa")] * 40
    schema = "doc_id long, text string, lang string"
    model = language.fit(spark.createDataFrame(learned, schema))
    for some in (rows, rows[:1], rows[:2], rows[-13:]):
        rates = [model.predict(*buffers(pa.array([t])), np.ones(1, bool))[2][0] for _, t, _ in some]
        got = language.most_rate(model, spark.createDataFrame(some + other, schema).repartition(3))
        assert math.isclose(got, language.MARGIN * np.quantile(rates, language.QUANTILE), rel_tol=1e-12)
    assert language.most_rate(model, spark.createDataFrame(other, schema)) == language.MAX_RATE


def test_held_out_long_texts_set_the_rejection_rate(spark):
    """Texts longer than those learned from, all of one kind, are a tenth of their language and stay."""
    rng = random.Random(6)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(voc) for _ in range(200)), "aa") for i in range(200)]
    rows += [(1000 + i, "".join(rng.choice("abcdefgh ") for _ in range(17_000)), "aa") for i in range(20)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert t.filter("doc_id >= 1000 AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2").count() > 3
    assert {r.doc_id for r in language.keep_identified(t).collect()} == {i for i, _, _ in rows}


def naive(model, x):
    """Score of one bag, passage by passage."""
    p, hs, gs = model.p, [], []
    for row in x:
        h = np.tanh(((row - model.mean) / model.scale) @ p["E"] + p["e"])
        gs.append(float(((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]).item()))
        hs.append(h)
    a = np.exp(np.array(gs) - max(gs))
    return 1 / (1 + math.exp(-float(((a / a.sum()) @ np.array(hs) @ p["c"] + p["d"]).item())))


def test_attention_by_hand():
    rng = np.random.default_rng(5)
    x, bound, label = rng.random((11, quality.FEATURES)), np.array([0, 4, 5, 11]), np.array([1.0, 0.0, 1.0])
    m = quality.Attention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    assert np.allclose(m.score(x, bound), [naive(m, x[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)])

    def loss():
        y = m.score(x, bound)
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))

    for name, grad in m.gradient(x, bound, label).items():
        for at in [tuple(rng.integers(0, n) for n in grad.shape) for _ in range(6)]:
            was = m.p[name][at]
            m.p[name][at] = was + 1e-6
            up = loss()
            m.p[name][at] = was - 1e-6
            down = loss()
            m.p[name][at] = was
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


def features(text):
    """Passages of a text by plain loops: frequencies of class pairs, repeated words, word length and number."""
    out, spans = [], [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    for at in range(0, max(len(spans), 1), quality.PASSAGE_WORDS):
        mine = spans[at : at + quality.PASSAGE_WORDS]
        row = np.zeros(quality.FEATURES)
        if mine:
            start = mine[0][0]
            end = spans[at + quality.PASSAGE_WORDS][0] if at + quality.PASSAGE_WORDS < len(spans) else len(text)
            for i in range(start, end):
                row[quality._CLASS[text[i]] * 8 + quality._CLASS[text[min(i + 1, len(text) - 1)]]] += 1 / (end - start)
            w = [text[a:b] for a, b in mine]
            row[64:] = sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), 1 - len(set(w)) / len(w), min(sum(map(len, w)) / len(w) / 20, 2), len(w) / quality.PASSAGE_WORDS
        out.append(np.sqrt(row))
    return np.array(out)


def test_passages_by_hand(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3)
    rng = random.Random(7)
    text = " ".join(rng.choice(["one", "two", "Three,", "4", "é.", "\n\nx", "y\t"]) for _ in range(500))
    x, bound = quality.encode(*buffers(pa.array([text])))
    assert bound.tolist() == [0, len(x)] and np.allclose(x, features(text.encode()), atol=1e-6)
    x, bound = quality.encode(*buffers(pa.array(["", None, " \n"])))
    assert bound.tolist() == [0, 1, 2, 3] and not x.any()


def test_quality_of_rows_it_has_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op5_attention_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    # a label of a held-out row changes nothing
    turned = labels.withColumn("quality", F.when(quality._held(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, x) for x in (labels, turned))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)


def test_quality_learns_from_long_texts_only(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["good", "fine", "Well."] if i % 2 else ["$$", "##1", "%%9"]) for _ in range(9000)), i % 2) for i in range(24)]
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.fit(t, t)
    got = {r.doc_id: r.score for r in quality.assess(t, m).collect()}
    assert min(got[i] for i, _, q in rows if q) > 0.7 and max(got[i] for i, _, q in rows if not q) < 0.3


def test_fingerprints_are_the_least_hashes(spark):
    """Both fingerprints and both likenesses, exactly, from every shingle's hash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).unionByName(
        spark.createDataFrame([(-5, None, 0), (-4, "", 0), (-3, "one two", 7), (-2, "one two", 7)], "doc_id long, text string, n_chars long"), allowMissingColumns=True
    )
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: r[0])
    whole = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        whole += [(2 * i, t), (2 * i + 1, t[: len(t) - half] + u[:half])]
    each = spark.createDataFrame(whole, "id long, t string").select("id", fingerprint.shingle_hashes(F.col("t")).alias("h"))
    least = {r.id: sorted(set(r.h))[: fingerprint.SKETCH] for r in each.collect()}

    def like(a, b):
        union = sorted({*a, *b})[: fingerprint.SKETCH]
        return len({*a} & {*b} & {*union}) / len(union) if union else 1.0

    show = lambda a: "".join(f"{v & 0xFFFFFFFF:08x}" for v in a)
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint.compare_edited(docs).collect()}
    for (i, _), (j, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b, n = least[2 * i], least[2 * i + 1], least[2 * j]
        assert got[i] == (show(a), show(b), like(a, b), like(a, n))


def test_memory_of_one_very_long_text():
    """What a worker holds for a text of 9 MB, by byte of it; the README says what that means for larger ones."""
    rng = random.Random(1)
    voc = [f"wort{i}" for i in range(5000)]
    text = " ".join(rng.choice(voc) for _ in range(1_000_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(raw)])
    model = language.Model({"x": text[:20_000].encode(), "y": text[20_000:40_000].encode()})
    for most, f in (
        (32, lambda: rules.measure(raw, offs)), (18, lambda: quality.encode(raw, offs)), (16, lambda: simhash.fingerprint_rows(raw, offs)),
        (16, lambda: substrings._anchors(kernel.Words(raw, offs), 13)), (16, lambda: copies.shingle_sets(raw, offs)), (8, lambda: model.phrases(raw, offs)),
    ):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(raw)


def test_a_word_longer_than_a_step_hashes_like_a_short_one(monkeypatch):
    raw = np.frombuffer(b"ab " + b"xyz" * 40 + b" ab", np.uint8)
    want = kernel.Words(raw, np.array([0, len(raw)])).hashes()
    monkeypatch.setattr(kernel, "STEP_BYTES", 16)
    assert (kernel.Words(raw, np.array([0, len(raw)])).hashes() == want).all() and want[0] == want[2] != want[1]


def test_spare_names(spark):
    d = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert spare(d, "a", "b", "b") == ["a__", "b", "b_"]
