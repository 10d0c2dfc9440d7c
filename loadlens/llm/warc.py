"""WARC archives: segmented writing, reading back, reassembly of segments.

Writing. A page becomes a WARC record whose block is an HTTP message with
chunked transfer framing. A block beyond SEGMENT bytes is cut into segments:
the record itself is segment 1, the others are continuation records that name
its id as their origin, and the last gives the total length. Pages whose
payload was seen before become revisit records without a payload. Records
end with two line ends, so Spark's text writer, with that as line separator,
writes the archives to any file system it knows, a file a task and ARCHIVE records.

Reading. Archives are parsed record by record by their content lengths.
Segments are grouped by origin, ordered by number and joined only if the
numbers are gapless and the total length agrees; then the framing is decoded
and the payload checked against its digest. What fails comes back with
intact = false and no payload.
"""

from __future__ import annotations

import gzip
import hashlib
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import broadcast_if_small, cut, remove, shared_folder, table

SEGMENT = 16_384  # bytes of a block
CHUNK = 4_096  # bytes of a transfer chunk
REVISIT = 100  # bytes that a payload needs to be revisited
ARCHIVE = 2_000  # records
DIGESTS = 200_000  # repeated payloads that are broadcast, by some 100 bytes each
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """An HTTP message with chunked transfer framing."""
    parts = [HTTP, b"Transfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(block: bytes) -> bytes | None:
    """The payload of an HTTP message; None if its framing is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(piece)
        at = end + 4 + size


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(page: dict, segment: int) -> list[bytes]:
    """The record of a page and its continuations."""
    own = f"<urn:uuid:{page['record_id']}>"
    url = " ".join((page["url"] or "").split()) or "about:blank"
    common = {"WARC-Target-URI": url, "WARC-Date": "2024-01-01T00:00:00Z"}
    first = {"WARC-Type": page["record_type"], "WARC-Record-ID": own, **common, "X-Page-ID": page["page_id"], "WARC-Payload-Digest": f"sha256:{page['digest']}"}
    if page["record_type"] == "revisit":
        return [record(first | {"WARC-Refers-To": f"<urn:uuid:{page['refers_id']}>"}, HTTP + b"\r\n")]
    block = framed(bytes(page["payload"]))
    if len(block) <= segment:
        return [record(first, block)]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record(first | {"WARC-Segment-Number": 1}, pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.UUID(page['record_id']), str(k))}>", **common, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k}
        out.append(record(more | ({"WARC-Segment-Total-Length": len(block)} if k == len(pieces) else {}), piece))
    return out


def _uuid(*cols: Column) -> Column:
    x = F.md5(F.concat_ws(":", *cols))
    return F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def typed(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, digest, record_type, record_id and refers_id.

    Of the rows with equal payloads of at least REVISIT bytes, those with the
    least page_id (null is greatest) are responses.
    """
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    no_id = F.col("page_id").isNull()
    firsts = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= REVISIT).groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    firsts = cut(firsts.where("copies > 1").drop("copies"))
    joined = rows.join(broadcast_if_small(firsts, DIGESTS), "digest", "left")
    again = F.coalesce((F.octet_length("payload") >= REVISIT) & F.col("first_id").isNotNull() & (no_id | (F.col("page_id") != F.col("first_id"))), F.lit(False))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _uuid(name, F.col("digest")).alias("record_id"),
        F.when(again, _uuid(F.col("first_id").cast("string"), F.col("digest"))).alias("refers_id"),
    )


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write pages(page_id, url, html) as gzipped WARC archives under path."""

    @F.pandas_udf("array<binary>")
    def built(page_id: pd.Series, url: pd.Series, payload: pd.Series, digest: pd.Series, record_type: pd.Series, record_id: pd.Series, refers_id: pd.Series) -> pd.Series:
        names = ["page_id", "url", "payload", "digest", "record_type", "record_id", "refers_id"]
        rows = zip(page_id, url, payload, digest, record_type, record_id, refers_id, strict=True)
        return pd.Series([records_of(dict(zip(names, row, strict=True)), segment) for row in rows], dtype=object)

    rows = typed(pages)
    # A page id travels as text, as a nullable number would become a float.
    made = rows.select(F.explode(built(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "payload", "digest", "record_type", "record_id", "refers_id")).alias("value"))
    made.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE).text(path)


FIELDS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "X-Page-ID": "page_id",
    "WARC-Target-URI": "url",
    "WARC-Payload-Digest": "digest",
    "WARC-Refers-To": "refers_to",
    "WARC-Segment-Origin-ID": "origin",
    "WARC-Segment-Number": "number",
    "WARC-Segment-Total-Length": "total",
}
PARSED = "record_type string, record_id string, page_id string, url string, digest string, refers_to string, origin string, number string, total string, block binary"


def parsed(archive: bytes) -> Iterator[dict]:
    """The records of an archive, gzipped or not."""
    data = gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        yield {name: head.get(field) for field, name in FIELDS.items()} | {"block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size + len(END)


def read_archives(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """A row for each record of the archives under path, segments apart; segments alone, or none of them, if asked for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows = [r for r in parsed(content) if segments is None or segments == (r["number"] is not None)]
                yield pd.DataFrame(rows, columns=[*FIELDS.values(), "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(read, PARSED)


def reassembled(records: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(record_id, record_type, page_id, url, digest, refers_to, payload, payload_bytes, payload_digest, intact), a row for each whole record.

    segments may be given apart from the records in one piece, which go
    straight through. Of equal segments, which come
    from repeated rows, one is used, and the record comes back as often as its first segment.
    """
    own = ["record_id", "record_type", "page_id", "url", "digest", "refers_to"]
    whole = records.where("number is null").select(*own, F.array("block").alias("pieces"), F.lit(True).alias("joined"))
    origin = F.coalesce("origin", "record_id")
    parts = (records if segments is None else segments).where("number is not null").withColumn("number", F.col("number").cast("int"))
    parts = parts.groupBy(origin.alias("origin_id"), "number").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (*own, "total", "block")])
    first = F.col("number") == 1
    grouped = parts.groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("pieces"),
        F.max(F.col("total").cast("long")).alias("total"),
        F.max(F.when(first, F.col("copies"))).alias("copies"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in own],
    )
    gapless = (F.element_at("pieces", 1)["number"] == 1) & (F.element_at("pieces", -1)["number"] == F.size("pieces"))
    length = F.aggregate(F.transform("pieces", lambda x: F.octet_length(x["block"]).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    joined = grouped.where("copies is not null").select(*own, F.col("pieces.block").alias("pieces"), F.coalesce(gapless & (length == F.col("total")), F.lit(False)).alias("joined"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    @F.pandas_udf("payload binary, sha256 string")
    def decoded(pieces: pd.Series) -> pd.DataFrame:
        payloads = [None if p is None else unframed(b"".join(p)) for p in pieces]
        return pd.DataFrame({"payload": payloads, "sha256": [None if p is None else hashlib.sha256(p).hexdigest() for p in payloads]}, dtype=object)

    every = whole.unionByName(joined.select(*own, "pieces", "joined"))
    found = every.select(*own, "joined", decoded(F.when(F.col("joined") & (F.col("record_type") == "response"), F.col("pieces"))).alias("d"))
    agrees = F.concat(F.lit("sha256:"), F.col("d.sha256")) == F.col("digest")
    intact = F.when(F.col("record_type") == "response", F.col("joined") & F.coalesce(agrees, F.lit(False))).otherwise(F.col("joined"))
    found = found.withColumn("intact", intact)
    payload = F.when(F.col("intact"), F.col("d.payload"))
    return found.select(*own, payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.when(F.col("intact"), F.col("d.sha256")).alias("payload_digest"), "intact")


def resolved(found: DataFrame) -> DataFrame:
    """reassembled() rows of pages with the size and digest of the full payload, revisits by way of their response."""
    sized = found.where("intact")
    page = F.when(F.col("page_id") != "", F.col("page_id")).cast("long")
    responses = sized.where("record_type = 'response'").select(page.alias("page_id"), "record_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    origins = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest", F.col("page_id").alias("origin_page")).dropDuplicates(["refers_to"])
    revisits = sized.where("record_type = 'revisit'").select(page.alias("page_id"), "record_id", "record_type", "refers_to").join(origins, "refers_to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.drop("refers_to").withColumnRenamed("origin_page", "refers_to").select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written and read back.

    The archives lie in the folder of spark.checkpoint.dir while they are needed. A null html is an
    empty payload; rows without a page_id keep null; rows that repeat the
    least page_id of a payload are all responses. Other columns are left out.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = reassembled(read_archives(spark, path, False), read_archives(spark, path, True))
    found = cut(found.drop("payload", "url", "digest"))
    remove(spark, path)
    return resolved(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= {REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
   CASE WHEN n >= {REVISIT} AND page_id <> first THEN first END AS refers_to FROM f"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
