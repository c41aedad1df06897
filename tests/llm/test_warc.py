import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from pathloom.llm import warc


def pages():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé<>\r\n ") for _ in range(n))
    big = [text(1500), text(999) + "é", text(4000)]
    rows = [(i, f"http://h{i % 7}.example.org:80/p/{i % 40}?q", text(rng.randrange(0, 1200))) for i in range(150)]
    rows += [(1000 + i, f"https://m.example.net/{i}", big[i % 3]) for i in range(40)]
    rows += [(2000, "http://a.b/", "x" * 999), (2001, "http://a.b/", "x" * 999), (2002, None, None), (2003, "", ""), (None, "http://n.u/", "z"), (None, None, big[2])]
    rows += [(2004, "odd\r\nurl%0D", "y" * 1000), (2005, "odd\r\nurl%0D", "y" * 1000), (2005, "odd\r\nurl%0D", "y" * 1000), (2006, "http://long/", "long é " * 300_000)]
    # One id and URL with two payloads, one of them that of another page.
    rows += [(3009, "http://u/", big[0] + "X"), (3009, "http://u/", big[0] + "Y"), (3003, "http://v/", big[0] + "Y"), (3004, "http://tab\t/%09", big[0] + "X")]
    return rows


def expected(rows):
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 1000 and same and i != max(same)
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None] += 1
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "PART_CAPTURES", 50)
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit("k")).repartition(3)
    archives, index = warc.folders(table)
    captures = warc.write_archives(table, archives)
    directory = warc.build_index(captures, index)
    got = warc.read_all(captures, directory, archives, index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert captures.select("file").distinct().count() > 3 and directory.count() > 2 and directory.agg(F.sum("blocks")).first()[0] > 20
    assert directory.agg(F.sum("n")).first()[0] == len(rows) == captures.count()

    # Every capture is found by its key, and the range that it names is one record; others are not found.
    none = [("zz,none)/", 1, "0"), ("", 77, "0"), ("u)/", 3009, "0")]
    wanted = captures.select("key", "page_id", "digest").union(spark.createDataFrame(none, "key string, page_id long, digest string"))
    found = {(r.key, r.page_id, r.digest): r.payload_bytes for r in warc.lookup(wanted, directory, index, archives).collect()}
    assert all(found[x] is None for x in none) and sum(v is None for v in found.values()) == 3
    assert len(found) == 3 + captures.select("key", "page_id", "digest").distinct().count()
    store, root = fs.FileSystem.from_uri(archives)
    c = captures.where("record_type = 'revisit'").first()
    fields, block = warc.parse_record(gzip.decompress(store.open_input_file(f"{root}/{c.file}").read_at(c.length, c.offset)))
    assert fields["WARC-Type"] == "revisit" and block == b"" and fields["WARC-Record-ID"] == f"<urn:page:{c.page_id}>"


def test_keys(spark):
    urls = ["http://WWW.Example.org:80/a?b", "https://user@x.y/", "https://x.y", "no scheme", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.capture_key(F.col("url"))).collect()]
    assert got == ["org,example,www:80)/a?b", "y,x)/", "y,x)", "no scheme", "", ""]


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    archives, index = warc.folders(table)
    captures = warc.write_archives(table, archives)
    assert warc.read_all(captures, warc.build_index(captures, index), archives, index).collect() == []


def test_a_record_of_another_payload_is_refused(spark):
    table = spark.createDataFrame([(1, "http://a/", "x" * 2000)], "page_id long, url string, html string")
    archives, _ = warc.folders(table)
    captures = warc.write_archives(table, archives)
    store, root = fs.FileSystem.from_uri(archives)
    file = f"{root}/{captures.first().file}"
    members = [m.replace(b"xxx", b"xyx") for m in warc._members(store.open_input_stream(file, compression=None))]
    with store.open_output_stream(file, compression=None) as out:
        out.write(b"".join(map(gzip.compress, members)))
    with pytest.raises(Exception, match="not the one"):
        warc.read_archives(captures, archives).collect()
