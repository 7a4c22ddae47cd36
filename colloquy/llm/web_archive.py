"""Content-addressed archive of web records: payloads once, exact record headers apart, records by joins.

An archive is a folder of two tables. ``payloads`` has each distinct payload's bytes once under its
SHA-256 digest; payloads of one digest are compared byte by byte before one of them stands for all.
``headers`` has the exact header block of every record as it stands in a WARC/1.1 file: of equal
payloads the record of the largest id is a response, the others revisit it. Reading parses the
headers, checks the stored bytes against their digests and joins the two; :func:`records` gives
the original records back, :func:`export` writes them as WARC files and :func:`read_files` reads such files.

Null payloads count as empty. Rows that are repeated are records of their own: of several with the
largest id one is the response. A null id is the least of all and is left out of the header. Control
characters, spaces and per cent signs of an address are written per cent encoded and come back as they
were; a null address is left out. An empty table makes an empty archive.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.shared import dropped, forget, shared_path, shuffle_cleanup, small_batches, written

#: Shorter payloads are never revisited.
LEAST_BYTES = 0
#: Records of an exported file at most.
FILE_RECORDS = 1000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(sha1_hex: Column) -> Column:
    """The 32 upper-case base32 letters of a digest of 40 hexadecimal digits: four letters for each five digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, BASE32)


_UNSAFE = (*range(33), 127)


def _escaped(url: Column) -> Column:
    """An address on one line: control characters, spaces and per cent signs are per cent encoded."""
    out = F.replace(url, F.lit("%"), F.lit("%25"))
    for code in _UNSAFE:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20%\x7F]"), out).otherwise(url)


def _unescaped(url: Column) -> Column:
    out = url
    for code in _UNSAFE:
        out = F.replace(out, F.lit(f"%{code:02X}"), F.lit(chr(code)))
    return F.when(F.contains(url, F.lit("%")), F.replace(out, F.lit("%25"), F.lit("%"))).otherwise(url)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(key: Column) -> Column:
    """A record id from a digest of what names the record."""
    h = F.sha2(key, 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _payload(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least_bytes: int = LEAST_BYTES) -> None:
    """Write the archive of ``pages`` below ``path``.

    Two scans of the pages: one keeps what the headers need, the other the payloads. A task leaves one row
    for each payload before the shuffle, so that no number of copies makes a group large. Payloads shorter
    than ``least_bytes`` are stored once too, but each of their records is a response.
    """
    spark = pages.sparkSession
    payload = _payload(html)
    light = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.sha1(payload).alias("sha1"),
        F.length(payload).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    light = written(light, "records")  # the rows' numbers are fixed from here on
    owner = light.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "row", "url")).alias("o"))
    owner = owner.select("digest", F.col("o.row").alias("owner"), _urn(_record_key("o.page_id", "o.row", "digest")).alias("of"), F.col("o.url").alias("of_url"))
    revisit = F.col("owner") != F.col("row")
    rows = light.join(owner, "digest", "left").withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(_record_key("page_id", "row", "digest"))),
        _field("WARC-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Target-URI", _escaped(F.col("url"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _field("WARC-Refers-To", F.when(F.col("revisit"), F.col("of"))),
        _field("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), _escaped(F.col("of_url")))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", (F.length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    done = rows.withColumn("http", http).select(F.concat(head, F.col("http")).cast("binary").alias("header"), "digest")
    one = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    same = F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    with shuffle_cleanup(spark):
        done.write.option("compression", "zstd").parquet(f"{path}/headers")
        one.select("digest", same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    dropped(light)


def _record_key(page_id: str, row: str, digest: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.col(row).cast("string"), F.col(digest))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records by their headers: ``(record_id, record_type, page_id, url, of, payload_digest, header, digest)``."""
    text = F.col("header").cast("string")
    line = lambda name: F.nullif(F.regexp_extract(text, rf"(?md)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))
    return spark.read.schema("header binary, digest string").parquet(f"{path}/headers").select(
        line("WARC-Record-ID").alias("record_id"),
        line("WARC-Type").alias("record_type"),
        line("WARC-Page-ID").cast("long").alias("page_id"),
        F.when(F.contains(text, F.lit("\r\nWARC-Target-URI: ")), _unescaped(F.regexp_extract(text, r"(?md)^WARC-Target-URI: ([^\r\n]*)\r$", 1))).alias("url"),
        line("WARC-Refers-To").alias("of"),
        F.regexp_replace(line("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        "header",
        "digest",
    )


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads ``(digest, payload, n_bytes, sha1)``, each checked against its digest."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    intact = F.when(F.sha2("payload", 256) == F.col("digest"), F.length("payload").cast("long"))
    return stored.select("digest", "payload", F.coalesce(intact, F.raise_error(F.lit("a stored payload differs from its digest")).cast("long")).alias("n_bytes"), base32(F.sha1("payload")).alias("sha1"))


def described(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive with its payload's size and digest: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Size and digest are made from the stored bytes once for each payload, and only they are joined to
    the headers; ``refers_to`` is the id of the record that a revisit names.
    """
    rows = headers(spark, path).drop("header", "url")
    bytes_ = payloads(spark, path).select("digest", "n_bytes", "sha1")
    response = rows.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("of_page"))
    own = rows.withColumn("of", F.coalesce("of", "record_id"))  # a response meets itself, so that no null key gathers them
    whole = own.join(bytes_, "digest").join(response, "of")
    agrees = F.when(F.col("sha1") == F.col("payload_digest"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header's digest differs from its payload's")))
    return whole.select("page_id", F.col("n_bytes").alias("payload_bytes"), agrees.alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.col("of_page")).alias("refers_to"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``(record_id, record_type, page_id, url, refers_to_record, header, payload)``.

    A revisit has the payload of the response that it refers to. In a file a record's bytes are its header,
    then the payload unless it is a revisit, then two line ends.
    """
    rows = headers(spark, path).join(payloads(spark, path).select("digest", "payload"), "digest")
    return rows.select("record_id", "record_type", "page_id", "url", F.col("of").alias("refers_to_record"), "header", "payload")


def export(spark: SparkSession, path: str, to: str, compressed: bool = True, file_records: int = FILE_RECORDS) -> None:
    """Write the archive as WARC files of at most ``file_records`` records below ``to``.

    They are written by Spark's text committer, whose line end is the last byte of a record's two line
    ends, and gzipped as a whole where ``compressed``. A revisit has no payload in them.
    """
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    whole = F.concat(F.col("header"), body, F.lit("\r\n\r").cast("binary")).cast("string")
    writer = records(spark, path).select(whole.alias("value")).write.option("maxRecordsPerFile", file_records)
    writer.option("compression", "gzip" if compressed else "none").text(to)


def _parsed(content: bytes) -> Iterator[tuple]:
    """``(record_id, record_type, page_id, header, payload)`` of a file's records; a revisit's payload is None."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        lines = content[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:] if line)
        stop = end + int(fields["Content-Length"])
        http = content.index(b"\r\n\r\n", end, stop) + 4
        kind, page = fields["WARC-Type"], fields.get("WARC-Page-ID")
        yield fields["WARC-Record-ID"], kind, page and int(page), content[at:http], None if kind == "revisit" else content[http:stop]
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        at = stop + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, page_id, header, payload)`` of all records in WARC files of :func:`export`.

    A revisit's payload is null; a file is read whole by one task, so files should be of bounded size.
    """
    schema = "record_id string, record_type string, page_id long, header binary, payload binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for content in b.column(0):
                columns = zip(*_parsed(content.as_buffer().to_pybytes()), strict=True)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "record_type", "page_id", "header", "payload"])

    small_batches(spark)
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(parse, schema)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive of ``pages`` and read it back: :func:`described`."""
    path = path or shared_path(pages.sparkSession, "archive")
    write(pages, path)
    return described(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 5), lambda j:
    (instr('0123456789abcdef', substr(h, CAST(5 * k + j + 1 AS INTEGER), 1)) - 1) * CAST(pow(16, 4 - j) AS BIGINT)))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: substr('{BASE32}', CAST(x // 32768 % 32 + 1 AS INTEGER), 1) || substr('{BASE32}', CAST(x // 1024 % 32 + 1 AS INTEGER), 1)
    || substr('{BASE32}', CAST(x // 32 % 32 + 1 AS INTEGER), 1) || substr('{BASE32}', CAST(x % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM g
"""
