import base64
import gzip
import hashlib
import random
import re
import uuid

from lectern.llm.warc_store import Original, WarcConfig, build_index, lookup, parse, record, round_trip, surt, write_archives

SCHEMA = "page_id long, url string, html string, at string"


def expected(rows, least=0):
    first = {}
    for p, _, h in rows:
        h = h or ""
        if len(h.encode()) >= least and p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        head = first.get(h or "")
        refers = head if head is not None and head != p else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"https://h{rng.randrange(5)}.Example.com:8080/p{rng.randrange(40)}?q=é", rng.choice(["", "<p>ü</p>\r\n\r\nx", f"body {rng.randrange(9)}", "long " * 30_000])) for k in range(300)]
    rows += [(900, None, None), (901, "not a url", "body 1"), (None, "http://a.b/", "unique"), (902, "http://a.b/", "body 2")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    found = round_trip(pages, WarcConfig(block_lines=7, file_bytes=20_000, open_files=2), folder=str(tmp_path / "w"), payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in found if r.record_type == "response")


def test_least_bytes_and_empty(spark):
    rows = [(1, "http://a/", "x"), (2, "http://a/", "x"), (3, "http://b/", "longer text"), (4, "http://b/", "longer text")]
    found = round_trip(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), least_bytes=5).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(rows, 5)
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup_of_some(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"t{k}", "") for k in range(100)] + [(7, "http://h/7", "t7", "")], SCHEMA)
    captures = write_archives(pages, str(tmp_path / "a"))
    directory = build_index(captures, str(tmp_path / "i"), WarcConfig(block_lines=3))
    asked = spark.createDataFrame([("h)/7", 7), ("h)/7", 8), ("h)/55", 55), ("zz", 1), ("", 0)], "key string, page_id long")
    found = lookup(asked, directory, str(tmp_path / "a"), str(tmp_path / "i"))
    assert sorted(r.page_id for r in found.collect()) == [7, 7, 55]


def test_keys_and_records(spark):
    urls = [("https://u:p@www.Ab.org:81/x/Y?z#f", "org,ab,www:81)/x/Y?z#f"), ("http://a", "a)"), ("mailto", "mailto"), (None, "")]
    rows = spark.createDataFrame(urls, "url string, key string")
    assert all(r.k == r.key for r in rows.select("key", surt(rows.url).alias("k")).collect())
    ident, date = uuid.uuid4(), "2024-02-03T04:05:06Z"
    back = parse(record(ident, date, 5, "http://x/\r\nEvil: 1", b"a\r\n\r\nb", None))
    assert back["payload"] == b"a\r\n\r\nb" and back["page_id"] == 5
    assert parse(record(ident, date, 6, None, b"abc", Original(5, "http://y/")))["refers_to"] == 5


def records(path):
    """The records of an archive, read by the standard alone: (header lines as pairs, block)."""
    raw = gzip.decompress(path.read_bytes())
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1"
        fields = {k.lower(): v for k, v in (line.decode().split(": ", 1) for line in lines)}
        assert len(fields) == len(lines)
        size = int(fields["content-length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield fields, rest[:size]
        raw = rest[size + 4 :]


def test_records_by_the_standard(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (3, "http://c/", "other"), (3, "http://c/", "same"), (None, "http://d/", "same")]
    captures = write_archives(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), str(tmp_path / "a"), WarcConfig(date="2024-02-03T04:05:06Z"))
    assert captures.count() == len(rows)
    found = [r for f in (tmp_path / "a").glob("*.warc.gz") for r in records(f)]
    assert len(found) == len(rows) and len({f["warc-record-id"] for f, _ in found}) == len(rows)
    for f, block in found:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["warc-record-id"]) and f["warc-type"] in ("response", "revisit")
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["warc-date"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        if f["warc-type"] == "revisit":
            assert f["warc-profile"].startswith("http://netpreserve.org/warc/1.1/revisit/") and f["warc-refers-to-target-uri"] == "http://a/"
            assert f["warc-refers-to-date"] == f["warc-date"] and block.endswith(b"\r\n\r\n")
    assert sorted(f["warc-type"] for f, _ in found) == ["response"] * 3 + ["revisit"] * 4


def test_one_page_with_several_payloads(spark):
    rows = [(5, "http://a/", "one"), (5, "http://a/", "two"), (7, "http://b/", "two"), (7, "http://b/", "two"), (9, "http://c/", "x " * 200_000)]
    found = round_trip(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), WarcConfig(read_bytes=100)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(rows)
