"""Archives and their index: records read back from real files, merging against sorting, and revisits against plain Python."""

import base64
import glob
import hashlib
import random
import re

import duckdb
import pytest

from barloom.llm import queries, warc

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def brute(rows, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page."""
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        start = first.get(html or "") if len(body) >= least else None
        again = start is not None and i != start
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", start if again else None))
    return sorted(out, key=repr)


def found(df, **options):
    out = warc.index(df, **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in out.collect()), key=repr)


AWKWARD = [
    (1, "http://www.Example.com:80/A?b=1#frag", "same"), (2, "https://m.example.com/a", "same"), (3, None, None), (4, "", ""), (None, "http://x.org/", "same"),
    (5, "http://x.org/sp ace\r\nX: y", "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"), (6, "not a url", "é" * 50_000), (7, "http://[bad", "same"),
    (8, "http://x.org:8080/", "\x00\r\n\r\n"), (8, "http://x.org:8080/", "\x00\r\n\r\n"), (None, None, "only without a key"),
]


def test_awkward_pages(spark):
    df = pages(spark, AWKWARD).repartition(3)
    assert found(df) == brute(AWKWARD)
    assert found(df, least_bytes=5) == brute(AWKWARD, 5)
    from pyspark.sql import functions as F

    assert found(df.withColumns({n: F.lit("clash") for n in ("_page", "_digest", "run", "key", "value")})) == brute(AWKWARD)
    assert found(pages(spark, [])) == []


def test_files_hold_the_pages(spark, tmp_path):
    path = warc.write_archives(pages(spark, AWKWARD).repartition(2), target=str(tmp_path / "warc"))
    bodies, offsets = [], {}
    for f in glob.glob(f"{path}/part-*"):
        content = open(f, "rb").read()
        for at, length, headers, block in warc.walk(content):
            offsets[f, at] = content[at : at + length]
            if headers["WARC-Type"] == "response":
                bodies.append(block.partition(b"\r\n\r\n")[2].decode())
            else:
                assert headers["WARC-Profile"] == warc.PROFILE and re.match("<urn:page:[13]:", headers["WARC-Refers-To"]) and not block.partition(b"\r\n\r\n")[2]
    want = {h or "" for _, _, h in AWKWARD}
    assert set(bodies) == want and len(bodies) == len(want) + 1  # a repeated row is stored twice
    for r in warc.merge_runs(warc.read_archives(spark, path)).collect():
        record = offsets[r.file.removeprefix("file:"), r.offset]
        assert len(record) == r.length and (r.url is None or f"WARC-Target-URI: {r.url}\r\n".encode() in record)
    with pytest.raises(ValueError, match="does not end"):
        list(warc.walk(next(iter(offsets.values()))[:-1]))


def test_surt():
    assert warc.surt("https://www.Example.com:443/A/b?Q=1#x") == "com,example)/a/b?q=1"
    assert warc.surt("http://a.b.org:8080") == "org,b,a:8080)/" and warc.surt(None) == "-" and warc.surt("mailto:x") == "mailto:x"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randbytes(2) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(k)]
    size, first, later = 3, [], []
    for r, keys in enumerate(runs):
        for a in range(0, len(keys), size):
            block = (r, keys[a : a + size], [(x, r) for x in keys[a : a + size]])
            (later if a else first).append((keys[a - 1] if a else b"", r, block))
    blocks = iter([b for _, _, b in [*first, *sorted(later, key=lambda x: x[:2])]])
    merged = list(warc.merge(blocks))
    assert merged == sorted((x, r) for r, keys in enumerate(runs) for x in keys)


def test_index_is_in_order_over_passes(spark, monkeypatch):
    rng = random.Random(5)
    hosts = ["hot.org"] * 30 + [f"h{i}.net" for i in range(10)]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.randrange(5)}", f"body {rng.randrange(400)}") for i in range(3000)]
    df = pages(spark, rows).repartition(9)
    monkeypatch.setattr(warc, "BLOCK", 16)
    for fan_in in (256, 2):
        monkeypatch.setattr(warc, "FAN_IN", fan_in)
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
        index = warc.index(df)
        got = [(r.urlkey, r.timestamp, r.page_id) for r in index.toLocalIterator()]
        want = sorted((warc.surt(u), got_stamp, i) for (i, u, _), got_stamp in zip(rows, stamps(len(rows))))
        assert sorted(got) == want
        parts = [p for p in index.rdd.glom().map(lambda rs: [(r.urlkey, r.timestamp, r.page_id) for r in rs]).collect() if p]
        for p in parts:  # ranges do not overlap, and each is sorted; a reading task may hold several
            assert sum(a > b for a, b in zip(p, p[1:])) <= 8
        assert sorted((tuple(r) for r in index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(rows)


def stamps(n):
    import datetime as dt

    return [f"{dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i):%Y%m%d%H%M%S}" for i in range(n)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_warc_archives"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_warc_archives"](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
