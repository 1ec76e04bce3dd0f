"""WARC archives: written from pages, read back, and assembled into one row per capture.

A capture is a transaction of three records: request, response (or revisit) and metadata. The first and
the last name the second as the record they are concurrent to; assembly joins them by that id.

Writing goes through Spark's text writer: a record ends with two line breaks, which is what the writer
puts after each row, so a lost task is simply written again. Pages are written by classes of size, and
an archive, a compressed file, holds as many records of its class as fit its bytes at the class's upper
bound: a run of large pages makes more archives, not larger ones. Records are found by their declared
lengths, never by searching for separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.columns import text_or_empty
from millrace.plans.scratch import remove, write_table

BREAK = "\r\n"
#: Payloads from this size on are stored once and revisited.
LEAST_REVISITED = 1000
#: Bytes of records that an archive holds before compression, at most, unless one page alone has more.
ARCHIVE_BYTES = 16 << 20
#: Payload sizes are told apart by these bounds; an archive holds pages of one class.
CLASSES = [16 << 10, 128 << 10, 1 << 20, 8 << 20]
#: Bytes of a page's three records besides its payload, addresses of ordinary length included.
PER_PAGE = 2000
#: Payload bytes after which the reader hands on what it has parsed.
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "declared_digest string, payload_digest string, payload_bytes bigint, payload binary"
)


def _id(kind: int) -> Column:
    """A record id made of the page's id and content, the same whenever it is computed again.

    The last 16 digits are the page id, the digit after the 8 tells a null page id.
    """
    digits = F.lpad(F.hex(F.coalesce(F.col("page_id"), F.lit(0))), 16, "0")
    content = F.lower(F.lpad(F.hex(F.crc32(F.concat_ws(" ", "url", "body"))), 8, "0"))
    null = F.when(F.col("page_id").isNull(), F.lit("1")).otherwise(F.lit("0"))
    return F.lower(
        F.concat(
            F.lit("<urn:uuid:"), content, F.lit(f"-{kind:04d}-8"), null, F.lit("00-"),
            F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12), F.lit(">"),
        )
    )


def page_of(record_id: Column) -> Column:
    """The page id within a record id that ``write_archives`` made, null if there is none."""
    digits = F.regexp_replace(F.substring(record_id, 30, 17), "-", "")
    page = F.conv(digits, 16, -10).cast("long")
    return F.when(F.substring(record_id, 26, 1) == "0", page)


def _record(kind: str, own_id: Column, content_type: str, block: Column, *headers: Column) -> Column:
    """A record without the two line breaks that end it; null headers are left out."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)),
        F.concat(F.lit("WARC-Record-ID: "), own_id), *headers,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), block)


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISITED) -> tuple[DataFrame, str]:
    """Adds ``body`` (the payload), ``digest``, ``response_id`` and ``original_id``: the record to refer to.
    Also returns the path of the table of groups that the result reads.

    Of equal payloads of ``least`` bytes or more, the record of the largest page id is the response;
    null ids come last, rows that agree in page id, address and payload share a record id and are all
    responses. Groups of one are dropped before the join, whose large side Spark can split.
    """
    body = text_or_empty(F.col("html"))
    named = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest"))
    named = named.withColumn("response_id", _id(2))
    large = F.octet_length("body") >= least
    keeper = F.max(F.struct("page_id", "response_id"))["response_id"].alias("original_id")
    size = F.octet_length("body").alias("size")
    groups = (
        named.filter(large)
        .groupBy("digest", size)
        .agg(keeper, F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    groups, path = write_table(groups, "revisited")  # written: Spark knows its size when it chooses the join
    return named.withColumn("size", F.octet_length("body")).join(groups, ["digest", "size"], "left"), path


def write_archives(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Writes ``page_id``, ``url`` and ``html`` of ``pages`` as archives under ``path``.

    A null html is an empty payload, a null address an empty one; line breaks in addresses are
    percent-encoded. Other columns are not stored. An empty table gives archives without records.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    of_class = sum((F.when(size > bound, 1).otherwise(0) for bound in CLASSES), F.lit(0))
    used = [r[0] for r in pages.select(of_class.alias("c")).distinct().collect()]  # one row per class
    for i, c in enumerate(sorted(used) or [0]):
        most = CLASSES[c] if c < len(CLASSES) else archive_bytes
        planned, groups = plan_revisits(pages.filter(of_class == c))
        _records(planned, date).write.mode("append" if i else "error").option(
            "maxRecordsPerFile", 3 * max(1, archive_bytes // (most + PER_PAGE))
        ).text(path, compression="gzip", lineSep=BREAK * 2)
        remove(pages.sparkSession, groups)


def _records(planned: DataFrame, date: str) -> DataFrame:
    """The three records of each page, as text."""
    url = F.regexp_replace(text_or_empty(F.col("url")), r"\r", "%0D")
    url = F.regexp_replace(url, r"\n", "%0A")
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    when = F.lit(f"WARC-Date: {date}")
    own = F.col("response_id")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), own)
    revisit = F.col("original_id") != own
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("size"), F.lit(BREAK * 2),
    )
    request = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{BREAK * 2}"))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(BREAK))
    response = _record(
        "response", own, "application/http; msgtype=response", F.concat(http, "body"), when, target, digest
    )
    refers = F.concat(F.lit("WARC-Refers-To: "), F.col("original_id"))
    again = _record(
        "revisit", own, "application/http; msgtype=response", http, when, target, digest, refers,
        F.lit(f"WARC-Profile: {PROFILE}"),
    )
    records = F.array(
        _record("request", _id(1), "application/http; msgtype=request", request, when, target, concurrent),
        F.when(revisit, again).otherwise(response),
        _record("metadata", _id(3), "application/warc-fields", fields, when, target, concurrent),
    )
    return planned.select(F.explode(records).alias("value"))


def read_records(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """The records under ``path`` of these types (all if none is given), with their payloads.

    ``payload`` is what follows the HTTP head, or the whole block of other records; ``payload_digest``
    is the SHA-1 of the full payload: computed for payloads, as declared for revisits, which have
    none; likewise ``payload_bytes``. Archives may be compressed, as a whole or record by record.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in columns]
        )
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for row in parse_archive(content.as_py(), kinds):
                    rows.append(row)
                    held += len(row[-1]) + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)

    columns = [tuple(c.split(" ")) for c in RECORD.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def parse_archive(data: bytes, kinds: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Rows of ``RECORD`` for each record in an archive, by the declared lengths."""
    import gzip
    import hashlib

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        at = stop + 4
        kind = head.get("warc-type")
        if kinds and kind not in kinds:
            continue
        payload, declared = data[start:stop], head.get("warc-payload-digest")
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = payload.partition(b"\r\n\r\n")
        if kind == "revisit":
            sizes = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(sizes[0].split(b":")[1]) if sizes else None
            digest = declared.rpartition(":")[2] if declared else None
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        yield (
            head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"),
            head.get("warc-target-uri"), declared, digest, size, payload,
        )


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under ``path``: structs ``response``, ``request``, ``metadata``.

    A record without partner has nulls there; of several requests (or metadata records) concurrent
    to one response, which archives need not have, the smallest by record id is joined, so each
    capture stays one row. Repeated responses stay rows of their own.
    """

    rows = read_records(spark, path)
    leads = F.col("record_type").isin("response", "revisit")
    captured = rows.withColumn("capture", F.when(leads, F.col("record_id")).otherwise(F.col("concurrent_to")))
    whole = Window.partitionBy("capture")
    own = F.struct("record_id", "target_uri", "payload_bytes", "payload")

    def partner(kind: str) -> Column:
        found = F.min(F.when(F.col("record_type") == kind, own)).over(whole)
        return F.when(F.col("capture").isNotNull(), found).alias(kind)

    response = F.struct(*(c for c in rows.columns if c != "concurrent_to"))
    joined = captured.select("capture", leads.alias("leads"), response.alias("response"), partner("request"), partner("metadata"))
    return joined.filter("leads").drop("leads")
