"""Web archives: round trips of records, files and odd rows."""

import base64
import hashlib

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.llm import web_archive as W

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/2 with space\r\nWARC-Type: revisit\r\n%41", "<p>one</p>"),
    (3, None, "<p>one</p>"),
    (4, "", None),
    (5, "http://b.example/ WARC-Page-ID: 77", ""),
    (6, "http://c.example/é", "漢字\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\x00\x85 " * 3),
    (7, "http://c.example/7", "x" * 3_000_000),
    (7, "http://c.example/7", "x" * 3_000_000),
    (None, "http://d.example/", "<p>one</p>"),
    (None, "http://d.example/", "alone"),
    (-8, "http://e.example/", "alone"),
]


def plain(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out, seen = [], set()
    top = {}
    for i, b in data:
        if b not in top or (i is not None and (top[b] is None or i > top[b])):
            top[b] = i
    for i, b in data:
        first = i == top[b] and b not in seen
        if first:
            seen.add(b)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[b]))
    return sorted(out, key=str)


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1))
    got = W.archived(pages, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for *_, h in ROWS})
    back = W.records(spark, str(tmp_path / "a")).collect()
    whole = sorted(((r.page_id, r.url, r.payload.decode()) for r in back), key=str)
    assert whole == sorted(((i, u, h or "") for i, u, h in ROWS), key=str)
    assert len({r.record_id for r in back}) == len(ROWS)
    kinds = {r.record_id: r.record_type for r in back}
    assert all(kinds[r.refers_to_record] == "response" for r in back if r.record_type == "revisit")


@pytest.mark.parametrize("compressed", [False, True])
def test_files(spark, tmp_path, compressed):
    """Standard files: every record at its length, the same headers and payloads, and again an archive from what was read."""
    W.write(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "a"))
    W.export(spark, str(tmp_path / "a"), str(tmp_path / "w"), compressed, file_records=2)
    got = {r.record_id: r for r in W.read_files(spark, str(tmp_path / "w")).collect()}
    want = W.records(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(want) == len(ROWS)
    for r in want:
        assert got[r.record_id].header == r.header and got[r.record_id].record_type == r.record_type and got[r.record_id].page_id == r.page_id
        assert got[r.record_id].payload == (None if r.record_type == "revisit" else r.payload)
        length = int(r.header.decode().split("\r\nContent-Length: ")[1].split("\r\n")[0])
        block = r.header.split(b"\r\n\r\n", 1)[1] + (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert length == len(block)


def test_short_payloads_are_never_revisited(spark, tmp_path):
    rows = [(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "long enough"), (4, "u", "long enough")]
    W.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), least_bytes=5)
    assert {(r.page_id, r.record_type) for r in W.described(spark, str(tmp_path / "a")).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_damage_is_seen(spark, tmp_path):
    W.write(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(PySparkException, match="differs from its digest"):
        W.described(spark, str(tmp_path / "b")).collect()


def test_many_copies(spark):
    """A third of all rows share one payload."""
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    assert sorted(map(tuple, W.archived(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)


def test_empty(spark):
    assert W.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_sql(spark):
    from colloquy.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '/root/testdata/sf0.01/pages.parquet' WHERE page_id % 2 = 0")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = {tuple(r) for r in con.execute(f"SELECT {names} FROM ({ORACLES['op13_web_archive']})").fetchall()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = W.archived(pages.unionByName(pages.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1000)))
    assert {tuple(r) for r in got.select(*names.split(", ")).collect()} == want
    assert QUERIES["op13_web_archive"](spark, "/root/testdata/sf0.01").count() == 250
