"""WARC archives without repeated payloads.

Only headers (id, address, size, digests) are shuffled to find, for each payload (SHA-256 and length), the record that stays a response; every other record of that payload becomes a revisit with a fresh header that refers to it and has no payload. Of the payloads, only those that a filter of the repeated ones may hold are shuffled to meet what was found; the others are written where they are. Records are put together by native expressions and written by Spark's text writer; the archives are read back by a parser that follows Content-Length, and revisits are joined to their responses.

Files are whole-file gzip, as Spark's writer makes them, not one member a record. Records are written by size class, each with as many to a part as keep it below some 256 MB before compression (a larger record is a part of its own), so parts can be read back as one row.

Defined results: a null page is an empty payload; a null address leaves out WARC-Target-URI, a null id leaves out Page-Id and ranks below all others; rows that repeat the largest id and payload are all responses, and revisits refer to that id; pages of any length that Spark can hold are written whole; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, save, table, workspace
from tallyloom.llm.runs import bits_for, filter_of, may_hold

#: Greatest payload of a size class, and records to a part; beyond the last class a part holds one record.
SIZE_CLASSES = ((1 << 16, 4096), (1 << 20, 256), (1 << 24, 16))
#: Shares that the records of one digest, or the revisits of one response, are dealt over.
SALTS = 16
#: Digits of base 32 (RFC 4648) and those that conv() writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date for runs that must give the same bytes again.
DATE = "2024-01-01T00:00:00Z"

RECORDS = "page_id bigint, record_id string, record_type string, refers_record string, target string, payload_digest string, payload_bytes bigint"


def payload_digest(text: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1 of the UTF-8 bytes: eight times 20 bits to four digits."""
    sha = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, its SHA-1 for the header as digest, its SHA-256 as key, and its size."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumns({"digest": payload_digest(F.col("html")), "key": F.sha2("html", 256), "size": F.octet_length("html").cast("bigint")})


def resolve_revisits(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """The rows of with_digests with `first`: the id and address of the response that a record repeats, null for responses."""
    rows = with_digests(pages)
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("key", "size").agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = save(firsts.select("key", F.col("size").alias("same_size"), "first"), f"{root}/firsts")
    bits = bits_for(firsts.count())
    asked = may_hold(rows, filter_of(firsts, "key", bits), "key", bits)
    dealt = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt.hint("shuffle_hash"), ["key", "salt"], "left")
    repeats = F.col("first").isNotNull() & (F.col("size") == F.col("same_size")) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    found = joined.select(*rows.columns, F.when(repeats, F.col("first")).alias("first"))
    alone = asked.where("not maybe").select(*rows.columns, F.lit(None).cast(found.schema["first"].dataType).alias("first"))
    return found.unionByName(alone)


def warc_text(date: str = DATE) -> Column:
    """One record without its closing blank lines, from the columns of resolve_revisits."""
    crlf = "\r\n"

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))

    def clean(url: Column) -> Column:
        return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")

    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf + crlf))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{crlf}WARC-Profile: {REVISIT_PROFILE}{crlf}")).otherwise(F.lit(f"WARC-Type: response{crlf}")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("key"))),
        F.lit(f"WARC-Date: {date}{crlf}"),
        header("WARC-Target-URI", clean(F.col("url"))),
        header("Page-Id", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", F.when(revisit, record_id(F.col("first.page_id"), F.col("key")))),
        header("WARC-Refers-To-Target-URI", clean(F.col("first.url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}{crlf}")).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        length.cast("string"),
        F.lit(crlf + crlf),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, classes: tuple[tuple[int, int], ...] = SIZE_CLASSES) -> None:
    """Writes deduplicated archives to the folder `path`."""
    spark = pages.sparkSession
    resolved_rows = resolve_revisits(pages, workspace(spark, "revisits"), min_bytes)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    least, greatest = pages.agg(F.min(size), F.max(size)).first()
    low = -1
    for high, records_per_file in (*classes, (1 << 31, 1)):
        if low < 0 or least is not None and greatest > low and least <= high:
            records = resolved_rows.where((F.col("size") > low) & (F.col("size") <= high)).select(warc_text(date).alias("value"))
            records.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
        low = high


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-cased names, block) of each record of one archive."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    stream = io.BufferedReader(stream, 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode().strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64())] + [(n, pa.string()) for n in ("record_id", "record_type", "refers_record", "target", "payload_digest")] + [("payload_bytes", pa.int64())])
    for batch in batches:
        for content in batch.column(0):
            cols: dict = {f.name: [] for f in schema}
            for head, block in parse_warc(content.as_py()):
                kind = head["warc-type"]
                payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                cols["page_id"].append(int(head["page-id"]) if "page-id" in head else None)
                cols["record_id"].append(head["warc-record-id"])
                cols["record_type"].append(kind)
                cols["refers_record"].append(head.get("warc-refers-to"))
                cols["target"].append(head.get("warc-target-uri"))
                cols["payload_digest"].append(None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode())
                cols["payload_bytes"].append(None if payload is None else len(payload))
            yield arrow_rows(cols, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; digest and size are those of the payload that the record itself carries."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with each revisit joined to its response: payload size and digest of the full payload, and the response's page."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_record")).agg(F.first("page_id").alias("to_page"), F.first("payload_digest").alias("to_digest"), F.first("payload_bytes").alias("to_bytes"))
    revisits = records.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    dealt = responses.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = revisits.select("page_id", "record_type", "refers_record", "salt").join(dealt, ["refers_record", "salt"], "left")
    full = joined.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"))
    own = records.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return own.unionByName(full)


def op3_warc_revisits(spark, sf_dir: str) -> DataFrame:
    root = workspace(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), f"{root}/archive")
    records = read_warc(spark, f"{root}/archive")
    records.write.parquet(f"{root}/records")
    return resolved(spark.read.schema(records.schema).parquet(f"{root}/records"))


OP3_SQL = r"""
with p as (
  select page_id, html, strlen(html) as payload_bytes, sha1(html) || '0' as h, max(page_id) over (partition by html) as first_id
  from (select page_id, coalesce(html, '') as html from pages)
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
         ((((strpos('0123456789abcdef', substr(h, cast(5 * i // 4 + 1 as bigint), 1)) - 1) * 16
            + strpos('0123456789abcdef', substr(h, cast(5 * i // 4 + 2 as bigint), 1)) - 1) >> cast(3 - (5 * i) % 4 as bigint)) & 31) as bigint), 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p
"""
