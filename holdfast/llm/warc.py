"""WARC archives: written with Spark's text writer, read back by content length, and assembled into captures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import workers_import

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
#: What ends a line and a record, and the profile of a revisit that names no payload of its own.
LINE, END = "\r\n", "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "2000-01-01T00:00:00Z"


def judge_payloads(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with page_id, payload, digest, size, and refers_to: the id of the equal payload that is stored, null if it is this one.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes, that with the smallest id is stored (a missing id comes last). Counting goes by digest, so copies vanish
    before the shuffle. Payloads move once, in the join with the few digests that occur twice; a hot digest is split there.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    full = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), *[c for c in ("url",) if c in pages.columns], payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"), F.sha2(payload, 256).alias("digest")
    )
    stored = full.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    stored = stored.where(F.col("n") > 1).select("digest", "first_id")
    joined = full.join(stored.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def _head(kind: str, record: Column, fields: dict[str, Column], length: Column) -> Column:
    named = [F.concat(F.lit(f"{name}: "), value, F.lit(LINE)) for name, value in fields.items()]
    known = [F.coalesce(x, F.lit("")) for x in named]
    first = F.concat(F.lit(f"WARC/1.1{LINE}WARC-Type: {kind}{LINE}WARC-Record-ID: "), record, F.lit(f"{LINE}WARC-Date: {WRITTEN}{LINE}"))
    return F.concat(first, *known, F.lit("Content-Length: "), length.cast("string"), F.lit(END))


def _uri(record: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), record, F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write archives under ``path``: for each page a response or revisit, its request, and its metadata, all UTF-8.

    Records are text and end with two line ends, so the text writer with that separator makes valid archives in any store that Spark
    writes to, compressed with gzip. A missing page is empty, a missing id or URL is left out. Line ends in a URL are escaped.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    judged = judge_payloads(source)
    target = F.regexp_replace("url", r"[\r\n]", "%0A")
    # Each row gets identifiers of its own, so that repeated rows stay separate captures.
    rows = judged.select("*", target.alias("target"), F.expr("uuid()").alias("r1"), F.expr("uuid()").alias("r2"), F.expr("uuid()").alias("r3"))
    about = {"WARC-Target-URI": F.col("target"), "X-Page-Id": F.col("page_id").cast("string")}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest"))}
    http = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: ")
    http = F.concat(http, F.col("size").cast("string"), F.lit(END))
    whole = F.octet_length(http) + F.col("size")
    kind = {"Content-Type": F.lit("application/http;msgtype=response")}
    response = F.concat(_head("response", _uri(F.col("r1")), {**about, **digest, **kind}, whole), http, F.col("payload"))
    refers = {"WARC-Profile": F.lit(IDENTICAL), "WARC-Refers-To-Page": F.col("refers_to").cast("string")}
    revisit = F.concat(_head("revisit", _uri(F.col("r1")), {**about, **digest, **refers, **kind}, F.octet_length(http)), http)
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("target"), F.lit("")), F.lit(f" HTTP/1.1{END}"))
    concurrent = {"WARC-Concurrent-To": _uri(F.col("r1"))}
    request = F.concat(_head("request", _uri(F.col("r2")), {**concurrent, **about, "Content-Type": F.lit("application/http;msgtype=request")}, F.octet_length(asked)), asked)
    noted = F.concat(F.lit("payload-length: "), F.col("size").cast("string"), F.lit(LINE))
    metadata = F.concat(_head("metadata", _uri(F.col("r3")), {**concurrent, **about, "Content-Type": F.lit("application/warc-fields")}, F.octet_length(noted)), noted)
    main = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    # One value per page, with the separators between its records inside it.
    rows.select(F.concat_ws(END, main, request, metadata).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # after a record, or between members
            at += 2
            continue
        version = _VERSION.match(data, at)
        end = data.find(b"\r\n\r\n", at)
        if not version or end < 0:
            raise ValueError(f"No WARC record at byte {at}.")
        headers = {}
        for line in data[version.end() : end].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        length = int(headers["content-length"])
        if start + length > len(data):
            raise ValueError(f"The record at byte {at} is cut off.")
        yield headers, data[start : start + length]
        at = start + length


_RECORD = [
    ("kind", "string", pa.string()),
    ("record_id", "string", pa.string()),
    ("capture_id", "string", pa.string()),
    ("page_id", "bigint", pa.int64()),
    ("url", "string", pa.string()),
    ("refers_to", "bigint", pa.int64()),
    ("digest", "string", pa.string()),
    ("actual_digest", "string", pa.string()),
    ("size", "bigint", pa.int64()),
    ("fields", "string", pa.string()),
    ("payload", "binary", pa.binary()),
]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path`` (``.gz`` files are unpacked), with the digest and size of each payload as read.

    ``capture_id`` is the id that a record is concurrent to, or its own. Files are tasks' units and are read whole, so they should
    not be far above the size in which Spark writes partitions. Unless ``payloads`` is asked for, payloads end in the task that reads them.
    """
    workers_import(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([(name, kind) for name, _, kind in _RECORD])

    def rows_of(name: str, content: bytes) -> Iterator[tuple]:
        import zlib

        if name.endswith(".gz"):
            parts = []
            while content:  # one member for all or one per record
                member = zlib.decompressobj(31)
                parts.append(member.decompress(content))
                content = member.unused_data
            content = b"".join(parts)
        for h, block in parse_records(content):
            kind, number, refers = h["warc-type"], h.get("x-page-id"), h.get("warc-refers-to-page")
            body = block
            if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
                body = block[block.find(b"\r\n\r\n") + 4 :]
            stored = kind == "response"
            yield (
                kind,
                h["warc-record-id"],
                h.get("warc-concurrent-to", h["warc-record-id"]),
                int(number) if number else None,
                h.get("warc-target-uri"),
                int(refers) if refers else None,
                h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                hashlib.sha256(body).hexdigest() if stored else None,
                len(body) if stored else None,
                block.decode("utf-8", "replace") if kind == "metadata" else None,
                body if stored and payloads else None,
            )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), _RECORD)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in rows_of(name.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2_000 or held >= 16_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(work, ", ".join(f"{name} {kind}" for name, kind, _ in _RECORD))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main (the response or revisit), request, metadata.

    The records of a transaction meet through the id that they are concurrent to, in one aggregate. A response without a request or
    metadata has null there; records that belong to no response are left out. Of two requests of one capture, that with the smaller id stays.
    """
    row = F.struct(*[F.col(c) for c in records.columns if c not in ("capture_id",)])

    def one(*kinds: str) -> Column:
        return F.min_by(F.when(F.col("kind").isin(*kinds), row), F.when(F.col("kind").isin(*kinds), F.col("record_id")))

    grouped = records.groupBy("capture_id").agg(
        one("response", "revisit").alias("main"), one("request").alias("request"), one("metadata").alias("metadata")
    )
    return grouped.where(F.col("main").isNotNull())


def archived(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, has_request, has_metadata.

    A revisit's payload is that of the response with the digest it names, wherever it lies; its size comes from there.
    """
    found = captures(read_records(spark, path, payloads=False))
    main = found.select("main.*", F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))
    stored = main.where(F.col("kind") == "response")
    revisits = main.where(F.col("kind") == "revisit")
    sizes = stored.groupBy(F.col("actual_digest").alias("digest")).agg(F.max("size").alias("of_size"))
    solved = revisits.join(sizes, "digest", "left")
    tail = ["has_request", "has_metadata"]
    return solved.select(
        "page_id", F.col("of_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", *tail
    ).unionAll(
        stored.select(
            "page_id", F.col("size").alias("payload_bytes"), F.col("actual_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", *tail
        )
    )
