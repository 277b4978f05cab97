import hashlib
import zlib

import pyarrow.fs
from pyspark.sql import functions as F

from kilohour.llm import warc
from kilohour.llm.common import shared_name

LONG, OTHER = "x" * 1000, "ü" * 500
ROWS = [
    (1, "http://a.example/p?q=1#f", LONG), (5, "https://b.example", LONG), (3, None, LONG), (2, "http://a.example/", "short"), (4, "http://a.example/", "short"),
    (6, "no url\r\nat all\t", None), (7, "http://a.example/", ""), (8, "http://WWW.A.example:80/p", OTHER), (9, "http://a.example/", OTHER),
    (None, "http://n.example/", LONG), (5, "https://b.example", LONG), (10, "http://big.example/", "y" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string"


def test_round_trip_index_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    archive = warc.write(pages, shared_name(spark, "warc-test"))
    got = archive.read(payloads=True).collect()
    assert len(got) == len(ROWS)
    tops = {LONG: 5, OTHER: 9}
    want = sorted(
        (
            (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i is not None and tops.get(h, i) != i else "response",
             tops[h] if i is not None and tops.get(h, i) != i else None)
            for i, _, h in ROWS
        ),
        key=repr,
    )
    assert sorted(((r["page_id"], *tuple(r)[2:6]) for r in got), key=repr) == want
    assert all(r["payload"] == bytearray(b"") for r in got if r["record_type"] == "revisit")
    # blocks are sorted by reversed host and hold at most three lines
    blocks = archive.directory.orderBy("first_key", "last_key").collect()
    assert max(b["lines"] for b in blocks) <= 3 and all(b["first_key"] <= b["last_key"] for b in blocks)
    asked = spark.createDataFrame([("http://a.example/",), ("http://www.a.example:80/p",), ("http://none.example/",), ("http://a.example/",)], "url string")
    found = archive.find(asked)
    assert sorted(r["page_id"] for r in found.collect()) == [2, 4, 7, 8, 9]
    assert sorted(r["page_id"] for r in archive.read(found).collect()) == [2, 4, 7, 8, 9]
    # every member is a whole gzip record of its own
    one = archive.captures().where("page_id = 2").first()
    files, root = pyarrow.fs.FileSystem.from_uri(archive.folder)
    data = files.open_input_file(f"{root}/{one['file']}").read_at(one["length"], one["offset"])
    head, http, payload = warc.parse(zlib.decompress(data, 31))
    assert head["WARC-Type"] == "response" and http["Content-Length"] == "5" and payload == b"short"


def test_keys_and_empty_table(spark):
    assert warc.url_key("HTTP://User@Www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.url_key("//x.y") == "y,x)/" and warc.url_key(None) == ")" and warc.url_key("plain#f") == ")plain"
    archive = warc.write(spark.createDataFrame([], SCHEMA).withColumn("digest", F.lit(1)), shared_name(spark, "warc-test"))
    assert archive.read().count() == 0 and archive.find(spark.createDataFrame([("http://a/",)], "url string")).count() == 0
