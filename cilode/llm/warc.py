"""Web archives: writing pages as WARC records, and assembling captures from them again.

Each page gives a request, a response or revisit, and a metadata record. Request and metadata
name the response they belong to as concurrent; reading joins the three on that identifier
and returns one nested row per capture.

Of pages with equal payloads, that with the largest id keeps its payload as the response;
the others become revisits that refer to it and hold HTTP headers only.

Archives are written by Spark's own writer, whose commits survive lost tasks, on any storage
Spark writes to: a row is a page's records, its line end the two line ends after a record.
They are read as runs between such line ends, which a task puts together again by the
lengths in the headers; no archive is held as a whole, only one record.

NULL payloads are empty. NULL urls are empty, blanks and line ends in them percent-encoded. Repeated
rows give repeated captures; rows that share id and payload are one capture, repeated. A page
with a NULL id is never the response of others while there is one with an id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cilode.llm.common import attached, shared_folder, stored

END = "\r\n"
GAP = END + END
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# All records of a crawl carry one date unless told otherwise.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
    "digest string, payload_bytes long, intact boolean, page_id long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's bytes: eight digits for forty bits at a time."""
    digest = F.sha1(payload.cast("binary"))
    digits = [F.lpad(F.conv(F.substring(digest, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _identifier(kind: str, page: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(">"),
    )


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends after it; headers without a value are left out."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(GAP), block)


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One row per page: its three records as one text."""
    payload = F.coalesce("html", F.lit(""))
    blank = {" ": "%20", "\r": "%0D", "\n": "%0A", "\t": "%09"}
    uri = F.coalesce("url", F.lit(""))
    for char, code in blank.items():
        uri = F.replace(uri, F.lit(char), F.lit(code))
    rows = pages.select(F.col("page_id").cast("long"), uri.alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    # Digests only are aggregated, and before they are shuffled.
    original = rows.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("__n"))
    rows = attached(rows, stored(original, "warc-digests"), "digest")

    page, digest = F.col("page_id"), F.col("digest")
    original_ = F.col("original")
    is_response = page.eqNullSafe(original_)
    response_id = _identifier("response", page, digest)
    kept = F.when(is_response, F.col("payload")).otherwise("")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(GAP),
        kept,
    )
    host = F.regexp_extract("uri", "^[^:/]+://([^/?#]*)", 1)
    path = F.regexp_extract("uri", "^[^:/]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(GAP))
    fields = F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(END))
    common = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.lit(date))]

    def other(kind: str, mime: str, block: Column) -> Column:
        return _record(
            [
                ("WARC-Type", F.lit(kind)),
                ("WARC-Record-ID", _identifier(kind, page, digest)),
                ("WARC-Concurrent-To", response_id),
                *common,
                ("Content-Type", F.lit(mime)),
            ],
            block,
        )

    answer = _record(
        [
            ("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
            ("WARC-Record-ID", response_id),
            *common,
            ("WARC-Profile", F.when(~is_response, PROFILE)),
            ("WARC-Refers-To", F.when(~is_response, _identifier("response", original_, digest))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        http,
    )
    parts = [
        other("request", "application/http;msgtype=request", get),
        answer,
        other("metadata", "application/warc-fields", fields),
    ]
    return rows.select(F.concat_ws(GAP, *parts).alias("value"))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write pages as gzipped archives below a new folder."""
    records(pages, date).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines)
    return {name.strip().lower().decode(): value.strip().decode() for name, _, value in pairs}


def parse(head: bytes, block: bytes, payloads: bool) -> tuple:
    """A row of RECORD from a record's header and block."""
    warc = _headers(head.split(b"\r\n")[1:])
    kind = warc.get("warc-type")
    digest = size = intact = page = payload = None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
        size = len(body)
        if kind == "revisit":
            size = int(_headers(http.split(b"\r\n")[1:]).get("content-length", 0))
        else:
            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
            intact, digest = found == digest, found
            payload = body if payloads else None
    elif kind == "metadata":
        value = _headers(block.split(b"\r\n")).get("page-id")
        page = int(value) if value else None
    return (
        warc.get("warc-record-id"), kind, warc.get("warc-concurrent-to"), warc.get("warc-refers-to"),
        warc.get("warc-target-uri"), warc.get("warc-date"), digest, size, intact, page, payload,
    )


def _parser(payloads: bool, batch_rows: int = 500):
    """Records from runs between double line ends, in the order of the archive."""
    types = [
        pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
        pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(),
    ]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def made(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        # Bytes since the last record, and how many of them the next step needs.
        buffer, needed, rows = bytearray(), 0, []
        for batch in batches:
            for piece in batch.column(0).cast(pa.binary()).to_pylist():
                buffer += piece
                buffer += b"\r\n\r\n"
                while len(buffer) >= needed:
                    # Only line ends stand between records, one run more at the end of a file.
                    blank = len(buffer) - len(buffer.lstrip(b"\r\n"))
                    del buffer[:blank]
                    cut = buffer.find(b"\r\n\r\n")
                    if cut < 0:
                        needed = len(buffer) + 1
                        break
                    head = bytes(buffer[:cut])
                    needed = cut + 4 + int(_headers(head.split(b"\r\n")[1:])["content-length"])
                    if len(buffer) < needed:
                        break
                    rows.append(parse(head, bytes(buffer[cut + 4 : needed]), payloads))
                    del buffer[:needed]
                    needed = 0
                    if len(rows) >= batch_rows:
                        yield made(rows)
                        rows = []
        if buffer.strip(b"\r\n"):
            raise ValueError("an archive ends within a record")
        if rows:
            yield made(rows)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives, one row each; payloads are checked, and returned if wanted.

    A file that Spark reads in one block, as all gzipped ones, is parsed where it is read. The blocks
    of a file that it splits go to one task in their order, as only the records before a place
    tell whether one begins there.
    """
    meta = F.col("_metadata")
    runs = spark.read.option("lineSep", GAP).text(path).select(
        "value",
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        (meta["file_block_length"] < meta["file_size"]).alias("split"),
    )
    whole = runs.where("not split").select("value").mapInArrow(_parser(payloads), RECORD)
    blocks = runs.where("split").withColumn("row", F.monotonically_increasing_id())
    ordered = blocks.repartition("file").sortWithinPartitions("file", "block", "row").select("value")
    return whole.unionByName(ordered.mapInArrow(_parser(payloads), RECORD))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: response with its request and metadata.

    Records that repeat under one identifier are counted, joined once, and repeated again.
    """

    def once(kind: list[str], key: str, name: str) -> DataFrame:
        fields = F.struct(*[c for c in found.columns])
        return (
            found.where(F.col("type").isin(kind) & F.col(key).isNotNull())
            .groupBy(F.col(key).alias("capture"))
            .agg(F.first(fields).alias(name), F.count("*").alias(f"n_{name}"))
        )

    answer = once(["response", "revisit"], "record_id", "response")
    request = once(["request"], "concurrent_to", "request").drop("n_request")
    metadata = once(["metadata"], "concurrent_to", "metadata").drop("n_metadata")
    whole = answer.join(request, "capture", "left").join(metadata, "capture", "left")
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_response")))).drop("__copy", "n_response")


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from archives."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages.select("page_id", "url", "html"), path)
    # Parsed once, however often the joins look at the records.
    whole = captures(stored(read(spark, path, payloads=False), "warc-records")).select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("original"),
        "capture",
    )
    whole = stored(whole, "warc-captures")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = whole.where(F.col("original").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
    revisits = whole.where(F.col("original").isNotNull())
    originals = whole.select(F.col("capture").alias("original"), F.col("page_id").alias("refers_to")).distinct()
    named = revisits.groupBy("original").agg(F.count("*").alias("__n")).join(originals, "original", "left")
    return responses.select(*columns).unionByName(attached(revisits, stored(named, "warc-originals"), "original").select(*columns))
