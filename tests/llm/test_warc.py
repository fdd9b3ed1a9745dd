import glob
import gzip
import random

import pytest
from compare import assert_same, duck

from tidemark.llm import warc
from tidemark.llm.common import work_folder
from tidemark.llm.queries import OP7_SQL, QUERIES


def test_keys():
    assert warc.surt("https://Blog.Example.com:443/a/b?x=1#top") == "com,example,blog)/a/b?x=1"
    assert warc.surt("http://example.com") == "com,example)/"
    assert warc.surt("http://u@example.com:8080?q=1") == "com,example:8080)/?q=1"
    assert warc.surt(None) == ""


def test_key_column_equals_key_function(spark):
    rng = random.Random(3)
    parts = ["http://", "https://", "//", "www.", "Ex", "ample", ".com", ".", ":80", ":8080", ":443", "/", "?", "#", "@", "a=b", "é", "\n", ":", "-"]
    urls = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(800)] + [None, "", "https://Blog.Example.com:443/a/b?x=1#top"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    for row in frame.select("url", warc.surt_column("url").alias("key")).collect():
        assert row.key == warc.surt(row.url), row.url


def test_ids_of_other_types(spark):
    for kind, ids in (("string", ["b", "a", "c"]), ("int", [2, 1, 3])):
        pages = spark.createDataFrame([(i, "http://a.org/", "<p>") for i in ids], f"page_id {kind}, url string, html string")
        out = warc.round_trip(pages)
        assert out.schema["refers_to"].dataType == pages.schema["page_id"].dataType
        first = min(ids)
        assert {(r.page_id, r.refers_to) for r in out.collect()} == {(i, None if i == first else first) for i in ids}


def test_records_round_trip_and_damage_is_found():
    payload = "<p>é\r\n\r\nx</p>".encode()
    data = warc.record(5, "http://a b/\n", payload, warc.digest_of(payload)) + warc.record(6, None, payload, warc.digest_of(payload), 5)
    (h1, p1), (h2, p2) = warc.parse_records(data)
    assert p1 == payload and p2 == b"" and h1["WARC-Type"] == "response"
    assert h2["WARC-Refers-To"] == "<urn:page:5>" and h2["WARC-Payload-Length"] == str(len(payload))
    with pytest.raises(ValueError):
        list(warc.parse_records(data[:-9]))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.record(5, "", payload, "WRONG")))


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    done, out = set(), []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        held = first.get(html or "")
        response = page_id == held and (html or "") not in done
        if response:
            done.add(html or "")
        out.append((page_id, len(raw), warc.digest_of(raw), "response" if response else "revisit", None if response else held))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [warc.COPIES, 3])
def test_archives_index_and_lookups(spark, monkeypatch, copies):
    monkeypatch.setattr(warc, "COPIES", copies)
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(i, f"http://h{i % 7}.example.com/{i}", f"<p>{i % 40}</p>") for i in range(90)]
    rows += [(100, None, None), (101, "http://x.org/", ""), (102, "", "é" * 100_000), (103, "http://h1.example.com/1", "again")]
    rows += [(200 + i, "http://hot.com/", "hot") for i in range(30)] + [(7, rows[7][1], rows[7][2]), (None, "http://n.org", "hot")]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, part int").repartition(5).cache()
    pages.count()
    folder = work_folder(spark, "test")
    directory = warc.write_archives(pages, folder)
    keys = pages.select(warc.surt_column("url").alias("key")).distinct()
    got = warc.look_up_keys(keys, directory, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    few = warc.look_up_keys(spark.createDataFrame([("com,hot)/",), ("org,absent)/",)], "key string"), directory, folder)
    assert few.count() == 30
    blocks = [warc.Block(r.first_key, r.last_key, r.shard, r.offset, r.size) for r in directory.orderBy("shard", "offset").collect()]
    assert len(blocks) > 5
    for url in {r[1] for r in rows if r[1]}:
        found = sorted(h["WARC-Record-ID"] for h, _ in warc.lookup(folder, blocks, url))
        want = sorted(f"<urn:page:{'null' if i is None else i}>" for i, u, _ in rows if u and warc.surt(u) == warc.surt(url))
        assert found == want, url
    assert warc.lookup(folder, blocks, "http://absent.org/") == []
    path = folder.removeprefix("file://")
    assert not glob.glob(f"{path}/*.draft")
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.warc.gz"))
    assert whole.count(b"WARC/1.1") == len(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op7_warc"](spark, sf), duck(sf), OP7_SQL)
