"""The pipeline's stages one after another, as the driver runs them."""

import collections

import corpus_pipeline
from keelson.llm import mixing, pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = (tmp_path / name).as_uri()
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.count() > 0 and docs.columns == (names if k < 4 else [*names, "position", "ids"])
    back = pieces.decode(docs.withColumnRenamed("text", "was"))
    assert back.filter("NOT (was <=> text)").count() == 0


def test_the_last_stage_has_the_order_of_the_mix(spark, tmp_path):
    """Texts over a chunk, which are encoded by another way, stand where the mix put them; positions are those of allot()."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r for r in mixing.allot(docs).collect()}
    want = sorted([(r.position, i) for i, r in a.items() if r.first_words] + [(r.again_position, i) for i, r in a.items() if r.again_words])
    order = (tmp_path / "order").as_uri()
    mixing.mixed(docs).write.parquet(order)
    read = spark.read.parquet(order)
    got = pieces.encode(mixing.placed(read), chunk=500)
    rows = sorted((r.position, r.doc_id) for r in got.select("position", "doc_id").collect())
    at = {round(t, 12) for t, _ in want}
    assert len(rows) == len(want) and len({p for p, _ in rows}) == len(rows)
    places = collections.defaultdict(set)
    for t, i in want:
        places[round(t, 12)].add(i)
    assert len(at) == len(places) and [i for _, i in rows] and all(i in places[round(t, 12)] for (t, _), (_, i) in zip(want, rows, strict=True))
    assert [r.doc_id for r in mixing.placed(spark.createDataFrame([(3,), (1,), (2,)], "doc_id long")).orderBy("position").collect()] == [3, 1, 2]


def test_each_stage_reads_what_the_one_before_wrote(spark, monkeypatch):
    given = []

    def seen(name, stage):
        def run(spark, docs, sf_dir):
            given.append((name, docs.inputFiles()))
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [seen(*x) for x in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF)
    names = [name for name, _ in given]
    for was, (_, files) in zip(names, given[1:], strict=False):
        assert files and all(f"/{was}-" in x for x in files)
    assert all(f"/{names[-1]}-" in x for x in out.inputFiles()) and out.count() > 0
