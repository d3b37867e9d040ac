"""Mixing sources to target weights along a time-varying curriculum.

A source's weight changes linearly over training time; its demand up to time t
is the integral of that schedule, scaled to its target.  A document's offset
among its source's words (in hash order) is therefore due where the demand
reaches it, and inverting the integral gives its training position.  A source
whose target passes its size starts over, at most once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import WORD
from .ordering import ranged, running
from .store import keep, scratch, spare

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, MAX_EPOCHS = 1.5, 2
#: Weight of a source at the start and at the end of training, relative to its mean, repeating like WEIGHTS.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), written.

    Sources in code-point order, null last, weigh weights[place mod n].  They
    share budget times all sizes; a target stops at max_epochs times its size
    and the excess is shared anew by weight, until none is above.  Sources fill
    up in order of what they can give over their weight, so sums along that
    order say where it stops: one row comes to the driver, however many
    sources there are.
    """
    order = [F.col("source").isNull(), F.col("source")]
    s = ranged(sizes.withColumn("one", F.lit(1)), *order, name="sources")
    s = running(s, "one", [], order, "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", "place", w.alias("w"), (F.col("source_size") * float(max_epochs)).alias("most"))
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    order = ["ratio", "place"]
    s = ranged(s, *order, name="weights")
    s = keep(running(running(s, "most", [], order, "held"), "w", [], order, "past"), "filled")
    total, every = s.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(budget * (total or 0)) - F.col("held")) / (F.lit(every or 1.0) - F.col("past"))
    level = s.select(level.alias("level"), *order).filter("level <= ratio").agg(F.min_by("level", F.struct(*order))).first()[0]
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("w") * level)
    return s.select("source", "source_size", "place", target.alias("target"))


def _due(share: F.Column, place: F.Column) -> F.Column:
    """Training time by which a source's demand reaches a share of its target."""
    out = share
    for i, (a, b) in enumerate(RAMPS):
        if a != b:
            at = (F.sqrt(F.lit(a * a) + F.lit((b - a) * (a + b)) * share) - a) / (b - a)
            out = F.when(place % len(RAMPS) == i, at).otherwise(out)
    return out


def allot(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, carry: str | None = None) -> DataFrame:
    """(doc_id, x, source, size, source_size, target, taken, first_words, again_words, position, again_position).

    x is a hash of the text.  size counts words, 0 for null text.  taken is
    first_words, out of the first pass over the source, and again_words, out of
    the second; the last document of a source's target is taken in part, so a
    source's taken words sum to its target rounded down.  Positions are null
    where nothing is taken.  Repeated rows are taken one by one; a null id or
    source is a value like others; an empty table gives an empty one.  Other
    columns of docs are not read; `carry`, a column that tells rows apart, is
    returned if given.
    """
    key = [carry] if carry else []
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("text").alias("x"), *key)
    order = [F.xxhash64("doc_id", "x"), F.col("doc_id"), F.col("x"), F.col("size"), *map(F.col, key)]
    # written first: finding the ranges reads the rows twice, which should not count words twice
    rows = ranged(keep(rows, "sizes"), F.col("source").isNull(), F.col("source"), *order, name="sized")
    of = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget)
    of = keep(of.withColumnRenamed("source", "_source"), "targets")
    rows = running(rows, "size", ["source"], order, "before")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("_source")))
    goal = F.floor(F.col("target") + 1e-6)
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
    first, again = part(F.col("before")), part(F.col("before") + F.col("source_size"))
    rows = rows.select("*", first.alias("first_words"), again.alias("again_words"))
    at = lambda start: _due(start / goal, F.col("place"))
    return rows.select(
        "doc_id", "x", "source", "size", "source_size", "target", (F.col("first_words") + F.col("again_words")).alias("taken"), "first_words", "again_words",
        F.when(F.col("first_words") > 0, at(F.col("before"))).alias("position"),
        F.when(F.col("again_words") > 0, at(F.col("before") + F.col("source_size"))).alias("again_position"), *key,
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The training set: rows of docs, each once for every pass that takes it, in order of training position.

    A copy that is taken in part keeps its first words, joined by one space.
    Columns stay as they are, whatever their names; repeated rows are taken one
    by one; an empty table gives an empty one.  Rows get a number and are
    written once, so that places are worked out on numbers and sizes alone, and
    a text moves twice: to its places, and into their order.
    """
    names = docs.columns
    num, of, size, at, n, again = spare(docs, "num", "of", "size", "at", "n", "again")
    copies = F.array(
        F.struct(F.col("position").alias("at"), F.col("first_words").alias("n"), F.lit(0).alias("again")),
        F.struct(F.col("again_position").alias("at"), F.col("again_words").alias("n"), F.lit(1).alias("again")),
    )
    with scratch(docs.sparkSession):
        rows = keep(docs.withColumn(num, F.monotonically_increasing_id()), "numbered", last=True)
        a = allot(rows.select("doc_id", "text", "source", F.col(num).alias("num")), carry="num").filter("taken > 0")
        a = a.select("num", "size", F.explode(copies).alias("c")).filter("c.n > 0").select("num", "size", "c.*").toDF(of, size, at, n, again)
        a = keep(a, "allotted", last=True)
    got = rows.join(a, F.col(num) == F.col(of)).orderBy(at, num, again)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    cut = F.col(n) < F.col(size)
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col(n).cast("int")), " ")).otherwise(F.col("text"))
    one = {"text": text}
    if "n_chars" in names:
        one["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.select(*[one.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def placed(docs: DataFrame, name: str = "position") -> DataFrame:
    """docs with a long column that ascends, with gaps, in the order in which its rows were written.

    A reader of Parquet deals files out by size, so rows come in another order
    than that of the writer's parts; file names and places within files still
    have it.  A table that isn't read from files is numbered as it comes.
    Nothing is shuffled.  A column of that name is replaced.
    """
    of = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(of, pattern, 1).try_cast("long"), F.lit(0))
    place = number(r"part-(\d+)") * (1 << 43) + number(r"-c(\d+)") * (1 << 33) + F.col("_metadata.row_index")
    try:
        return docs.select(*[docs[n] for n in docs.columns if n != name], place.alias(name))
    except AnalysisException:  # not a table of files
        pass
    return docs.withColumn(name, F.monotonically_increasing_id())


def op2_curriculum(spark, sf_dir: str) -> DataFrame:
    got = allot(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "position", "again_position").orderBy("position", "doc_id")
