"""WARC archives with revisit records for repeated payloads.

Only headers (page, digest, length) are shuffled by digest; the least page of
each digest keeps its payload, the others become revisits that refer to it.
Archives are written by Spark's text writer, whose line separator is the blank
line that ends a WARC record, so any file system that Spark knows will do, and
are read back by their Content-Length fields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, in_arrow, keep, parts, scratch

#: Shorter payloads are never revisits.
LEAST_BYTES = 100
#: Bytes of payload that one archive file holds, about; a reading task holds one file.
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def heads(pages: DataFrame) -> DataFrame:
    """(page_id, n, digest) of every row; null html is an empty payload."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("n"), F.sha2(body, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(revisit, digest, original): payloads of LEAST_BYTES or more of pages that a lesser page_id has too.  Written."""
    h = keep(heads(pages).filter((F.col("n") >= LEAST_BYTES) & F.col("page_id").isNotNull()), "heads")
    first = h.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last")).filter("original < last")
    first = keep(first.select(F.col("digest").alias("_d"), "original"), "originals")
    got = h.join(first, F.col("digest") == F.col("_d")).filter("page_id > original")
    return keep(got.select(F.col("page_id").alias("revisit"), "digest", "original").distinct(), "revisits")


def _field(name: str, value: F.Column) -> F.Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """An archive of one record per row of pages (page_id, url, html), by the rules of revisits().

    Line breaks in a url are percent-encoded.  Rows without an id are always
    responses; rows that repeat an id are judged each by its own payload, so
    there is a record for every row; an empty table gives an archive without
    records.  Other columns of pages are not read.  With compression "none" the
    archives are plain WARC files, in which a record can be sought; a gzip file
    is one stream.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(parts(pages.sparkSession), size // FILE_BYTES + 1)
    with scratch(pages.sparkSession):
        again = revisits(pages)
        _write(pages, again, files, path, compression)


def _write(pages: DataFrame, again: DataFrame, files: int, path: str, compression: str) -> None:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    p = p.join(again, (F.col("page_id") == F.col("revisit")) & (F.col("_digest") == F.col("digest")), "left")
    is_new = F.col("original").isNull()
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(is_new, F.col("html")).otherwise(F.lit("")))
    ident = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(is_new, F.lit("response")).otherwise(F.lit("revisit"))),
        _field("WARC-Record-ID", ident(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        _field("X-Payload-Length", F.octet_length("html")),
        F.when(is_new, F.lit("")).otherwise(
            F.concat(_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", ident(F.col("original"))))
        ),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block)),
    )
    record = F.concat(head, F.lit("\r\n"), block).alias("value")
    rows = p.select("page_id", record).repartition(files, "page_id") if files > parts(pages.sparkSession) else p.select(record)
    rows.select("value").write.option("lineSep", _END).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive file."""
    at = 0
    while at < len(data):
        stop = data.index(_END.encode(), at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        field = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + 4
        end = start + int(field["Content-Length"])
        if data[end : end + 4] != _END.encode():
            raise ValueError(f"no end of record at byte {end}")
        yield field, data[start:end]
        at = end + 4


def read(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for raw in batch.column(0):
                out: list[tuple] = []
                for field, block in parse(gzip.decompress(data) if (data := raw.as_py())[:2] == b"\x1f\x8b" else data):
                    page = field["WARC-Record-ID"][len("<urn:page:") : -1]
                    digest, size = field["WARC-Payload-Digest"].removeprefix("sha256:"), int(field["X-Payload-Length"])
                    to = field.get("WARC-Refers-To")
                    if field["WARC-Type"] == "response":
                        body = block[block.index(_END.encode()) + 4 :]
                        if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
                            raise ValueError(f"page {page}: the payload isn't what the header says")
                    out.append((None if page == "none" else int(page), size, digest, field["WARC-Type"], to and int(to[len("<urn:page:") : -1])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    return in_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    at = fresh(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    return read(spark, at)


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_BYTES} GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first < p.page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= {LEAST_BYTES}
"""
