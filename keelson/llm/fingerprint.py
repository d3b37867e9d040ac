"""Bottom-k sketches of word shingles, in DataFrame functions alone.

A sketch is the ascending array of the k least distinct 32-bit hashes of a
text's shingles.  The sketch of a whole is a merge of sketches of its parts, so
it can be combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import WORD
from .ordering import ranged
from .store import keep

SHINGLE_WORDS, SKETCH = 5, 128
_NONE = -(1 << 63)


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """32-bit hashes of the shingles of `width` words; a shorter text is one shingle, one without words has none."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    top = lambda h: F.shiftright(h, 32).cast("int")

    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: top(F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
        whole = F.array(top(F.xxhash64(h)))
        return F.when(n >= width, many).when(n > 0, whole).otherwise(F.array().cast("array<int>"))

    # a lambda's argument is evaluated once
    return F.flatten(F.transform(F.array(words), of))


def sketch(text: Column, k: int = SKETCH, width: int = SHINGLE_WORDS) -> Column:
    """array<int>; a null text counts as empty."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), width))), 1, k)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, keys: list[str], col: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch for each key.  The k least of each key's hashes are ranked, so no task holds a key's whole sketches."""
    each = sketches.select(*keys, F.explode(col).alias("h")).groupBy(*keys, "h").agg(F.lit(1).alias("one"))
    salted = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, F.pmod("h", F.lit(64))).orderBy("h"))).filter(F.col("_r") <= k)
    low = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(col))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimate of shared over all shingles; 1 for two empty sketches."""
    u = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared / F.size(u))


def distinct(a: Column, k: int = SKETCH) -> Column:
    """Estimate of the number of distinct shingles."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**31)) / F.lit(2.0**32)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / top)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimate of the share of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(id, x, n, nid, nx): each document's key and length, and the key of the next by id, after the last the first.

    A key is the id (null as the least long, so first) and a hash of the text;
    equal rows are one document.  Written.
    """
    ids = docs.select("id", "x", F.length("text").cast("long").alias("n")).distinct()
    r = ranged(ids, "id", "x", name="ids")
    here = F.struct("id", "x")
    r = r.withColumn("next", F.lead(here).over(Window.partitionBy("_p").orderBy("id", "x")))
    # one row for each range
    heads = r.groupBy("_p").agg(F.min(here).alias("head"))
    after = heads.select(F.col("_p").alias("_q"), F.coalesce(
        F.lead("head").over(Window.orderBy("_p")), F.min("head").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("after"))
    r = r.join(F.broadcast(after), F.col("_p") == F.col("_q")).withColumn("next", F.coalesce("next", "after"))
    return keep(r.select("id", "x", "n", F.col("next.id").alias("nid"), F.col("next.x").alias("nx")), "next")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document; see op6 for the columns.

    Null text is an empty one, null ids come first, rows that repeat id and
    text are one document with a row each; one document is its own next.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("x"), "text")
    links = with_next(rows)
    base = rows.withColumn("fp", sketch(F.col("text")))
    # a running count, not a rank: a limit by rank would be pushed below the shuffle, which then could not be shared with the other side
    nth = F.count(F.lit(1)).over(Window.partitionBy("id", "x").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    want = links.select("nid", "nx", F.floor(F.col("n") / 2).cast("int").alias("need"), F.col("id").alias("pid"), F.col("x").alias("px"))
    nxt = base.withColumn("nth", nth).filter("nth = 1").join(want, (F.col("id") == F.col("nid")) & (F.col("x") == F.col("nx")))
    nxt = nxt.select("pid", "px", "need", F.expr("left(text, need)").alias("head"), F.col("fp").alias("next_fp"))
    got = base.join(nxt, (F.col("id") == F.col("pid")) & (F.col("x") == F.col("px")))
    n = F.length("text")
    got = got.select("id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.expr("left(text, length(text) - need)"), "head").alias("edited"))
    got = got.withColumn("edited_fp", sketch(F.col("edited")))
    return got.select(
        F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op6_bottom_k(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
