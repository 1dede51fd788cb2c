import json

import pytest
from pyspark.sql import types as T

from lectern.operators import dml
from lectern.sources import artifacts, connectors, xml_feeds
from lectern.streaming import ingest

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2401.00007v2</id><title>On
  Small  Things</title><summary>We study. Code: https://github.com/o/r.</summary><published>2024-01-05T10:00:00Z</published><updated>2024-02-01T00:00:00Z</updated>
<author><name>Ada  L.</name></author><author><name>Bo</name></author><arxiv:primary_category term="cs.CR"/><category term="cs.LG"/><category term="cs.CR"/><arxiv:doi>10.1/x</arxiv:doi><link rel="alternate" href="http://arxiv.org/abs/2401.00007v2"/></entry>
<entry><id>http://arxiv.org/api/errors#x</id><title>Error</title></entry>
<entry><id>http://arxiv.org/abs/hep-th/9901001</id><title>Old</title><summary>s</summary><published>1999-01-01T00:00:00Z</published><category term="hep-th"/></entry></feed>"""
OAI = """<?xml version="1.0"?><OAI-PMH><ListRecords>
<record><header><identifier>a</identifier></header><metadata><arXiv><id>2401.1</id><created>2024-01-02</created><authors><author><keyname>Curie</keyname><forenames>Marie</forenames></author><author><keyname>Plato</keyname></author></authors><title>T  t</title><categories>cs.LG  stat.ML</categories><doi>10.1/a 10.2/b</doi><abstract> x </abstract></arXiv></metadata></record>
<record><header status="deleted"><identifier>b</identifier></header></record>
<resumptionToken completeListSize="7">tok</resumptionToken></ListRecords></OAI-PMH>"""
NONE = """<?xml version="1.0"?><OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>"""
BAD = """<?xml version="1.0"?><OAI-PMH><error code="badArgument">no</error></OAI-PMH>"""


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    rows = {r.arxiv_id: r for r in xml_feeds.atom_entries(spark, str(tmp_path / "a.xml")).collect()}
    assert set(rows) == {"2401.00007", "hep-th/9901001"}
    r = rows["2401.00007"]
    assert (r.version, r.title, r.authors, r.primary_category, r.categories, r.doi, r.code_url) == (2, "On Small Things", ["Ada L.", "Bo"], "cs.CR", ["cs.CR", "cs.LG"], "10.1/x", "https://github.com/o/r")
    old = rows["hep-th/9901001"]
    assert old.version == 1 and old.updated_utc == old.published_utc and old.primary_category == "hep-th"


def test_oai(spark, tmp_path):
    for name, body in (("p", OAI), ("n", NONE), ("b", BAD)):
        (tmp_path / f"{name}.xml").write_text(body)
    r = xml_feeds.oai_records(spark, str(tmp_path / "p.xml")).collect()
    assert len(r) == 1 and (r[0].authors, r[0].categories, r[0].doi, r[0].title, r[0].primary_category) == (["Marie Curie", "Plato"], ["cs.LG", "stat.ML"], "10.1/a", "T t", "cs.LG")
    assert r[0].updated_utc == r[0].published_utc
    page = xml_feeds.oai_pages(spark, str(tmp_path / "p.xml")).first()
    assert (page.token, page.complete_size, page.error) == ("tok", 7, None)
    assert xml_feeds.oai_pages(spark, str(tmp_path / "n.xml")).first().error is None
    assert xml_feeds.oai_pages(spark, str(tmp_path / "b.xml")).first().error == "badArgument"


def test_artifacts(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"version": 1, "queries": [{"id": "a", "query": "x", "plan": {"anchorText": "t", "categories": ["c"]}}]}, indent=1))
    q = artifacts.eval_queries(spark, str(tmp_path / "q.json")).first()
    assert q.id == "a" and q.plan.categories == ["c"]
    assert artifacts.judgments(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception):
        artifacts.eval_queries(spark, str(tmp_path / "none.json")).collect()
    papers = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "arxiv_id string, v int")
    artifacts.export_corpus(papers, papers.where("v < 3"), str(tmp_path / "out"))
    table = artifacts.seed_corpus(spark, str(tmp_path / "out"), str(tmp_path / "table"), papers.schema)
    assert sorted(r.arxiv_id for r in table.collect()) == ["a", "b"]
    with pytest.raises(Exception):
        artifacts.seed_corpus(spark, str(tmp_path / "out"), str(tmp_path / "table"), papers.schema)
    built = []
    for _ in range(2):
        artifacts.snapshot_or_build(spark, str(tmp_path / "snap"), lambda: built.append(1) or papers)
    assert built == [1]


def test_connectors(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(7)], "id long, text string")
    out = connectors.in_batches(rows, "id", "text", lambda xs: [len(x) if x != "t3" else None for x in xs], "n", "long", size=3)
    assert sorted((r.id, r.n) for r in out.collect() if r.n is not None) == [(k, 2) for k in range(7) if k != 3]
    calls, pages = [], {None: ("p1", "x"), "x": ("p2", None)}

    def fetch(token):
        calls.append(token)
        if len(calls) == 1:
            raise OSError("busy")
        return pages[token]

    assert list(connectors.harvest(fetch)) == [(None, "p1"), ("x", "p2")] and calls == [None, None, "x"]
    now, slept = [0.0], []
    throttle = connectors.Throttle(3, lambda: now[0], slept.append)
    throttle.wait()
    now[0] = 1
    throttle.wait()
    assert slept == [2.0]
    for k in range(5):
        (tmp_path / f"p{k}.txt").write_text(f"body {k}")
    spark.dataSource.register(connectors.PagedSource)
    got = spark.read.format("paged_pages").option("path", str(tmp_path)).option("pages", 2).load()
    assert sorted((r.page, r.body) for r in got.collect()) == [(f"p{k}.txt", f"body {k}") for k in range(5)]


def test_merge_stream_resumes(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    paths = [str(tmp_path / x) for x in ("pages", "table", "check")]

    def run():
        ingest.merge_stream(spark, paths[0], schema, paths[1], paths[2], "k", "v", 1, compact_every=2).awaitTermination()
        return {r.k: r.v for r in ingest.current(spark, paths[1], schema, "k").collect()}

    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], schema).coalesce(1).write.mode("append").parquet(paths[0])
    assert run() == {"a": 2, "b": 1}
    spark.createDataFrame([("b", 5), ("c", 1)], schema).coalesce(1).write.mode("append").parquet(paths[0])
    assert run() == {"a": 2, "b": 5, "c": 1} and run() == {"a": 2, "b": 5, "c": 1}
    for v in range(3):
        spark.createDataFrame([("d", v)], schema).coalesce(1).write.mode("append").parquet(paths[0])
        assert run() == {"a": 2, "b": 5, "c": 1, "d": v}
    assert artifacts.versions(spark, paths[1]) == ["b000000000001", "b000000000003", "d000000000002", "d000000000003", "d000000000004"]
    rows = spark.read.parquet(f"{paths[1]}/d000000000004").collect()
    assert [(r.k, r.v) for r in rows] == [("d", 2)]  # a batch writes its own rows only


def test_work_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("attempts", T.IntegerType())])
    paths = [str(tmp_path / x) for x in ("items", "results", "check")]
    spark.createDataFrame([(1, 0), (1, 0), (2, 5), (3, 1), (4, 3)], schema).coalesce(1).write.parquet(paths[0])

    def run(able):
        ingest.work_stream(spark, paths[0], schema, paths[1], paths[2], lambda d: d.select("id").where(able), "id").awaitTermination()
        return [sorted(r.id for r in spark.read.parquet(f"{paths[1]}/{x}/*").collect()) for x in ("done", "poison")]

    assert run("id < 3") == [[1], [2]]
    assert run("id < 4") == [[1, 3], [2]]  # 3 and 4 came again with an attempt more
    assert run("id < 4") == [[1, 3], [2, 4]] and run("id < 9") == [[1, 3], [2, 4]]


def test_feed_totals_and_other_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM.replace("<entry>", '<opensearch:totalResults xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/">81</opensearch:totalResults><entry>', 1))
    totals, entries = xml_feeds.atom_feed(spark, str(tmp_path / "a.xml"))
    assert [r.total for r in totals.collect()] == [81] and entries.count() == 2
    (tmp_path / "b.xml").write_text("<html><body>down</body></html>")
    with pytest.raises(xml_feeds.NotAFeed):
        xml_feeds.atom_feed(spark, str(tmp_path))


def test_busy_services_and_empty_pages():
    calls, slept = [], []

    def fetch(token):
        calls.append(token)
        if len(calls) < 3:
            raise connectors.Busy([90, 4][len(calls) - 1])
        return "page", None

    assert list(connectors.harvest(fetch, sleep=slept.append)) == [(None, "page")] and slept == [60.0, 4]
    asked, entries = [], list(range(7))

    def ask(category, since, until, start, size):
        asked.append(start)
        return (7, []) if len(asked) == 2 else (7, entries[start : start + size])

    assert list(connectors.paged(ask, "c", "a", "b", 3)) == [[0, 1, 2], [3, 4, 5], [6]] and asked == [0, 3, 3, 6]
    assert list(connectors.paged(lambda *a: (9, []), "c", "a", "b")) == [] and list(connectors.paged(lambda *a: (0, []), "c", "a", "b")) == []
    assert list(connectors.paged(lambda c, s, u, at, n: (7, entries[at : at + n]), "c", "a", "b", 3, most=4)) == [[0, 1, 2], [3]]


def test_harvest_stream_resumes(spark, tmp_path):
    pages, sink, check = (tmp_path / x for x in ("pages", "sink", "check"))
    pages.mkdir()
    write = lambda token, following: (pages / f"p{token}.json").write_text(json.dumps({"token": token, "next": following, "body": f"body {token}"}))
    write("", "t1")
    write("t1", "t2")
    spark.dataSource.register(connectors.HarvestStream)

    def run():
        rows = spark.readStream.format("harvest_pages").option("path", str(pages)).load()
        query = rows.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(check)).start()
        query.processAllAvailable()
        seen = ingest.processed(query)
        query.stop()
        return seen, sorted(r.body for r in spark.read.schema("token string, body string").parquet(str(sink)).collect())

    assert run()[1] == ["body ", "body t1"]
    write("t2", None)
    seen, bodies = run()
    assert bodies == ["body ", "body t1", "body t2"] and seen == 1


def test_published_versions_and_usage(spark, tmp_path):
    path, rows = str(tmp_path / "index"), spark.createDataFrame([(1,)], "v int")
    assert artifacts.published(spark, path) is None
    for v in range(1, 5):
        assert artifacts.publish(spark, path, rows.selectExpr(f"v * {v} AS v")).first().v == v
    (tmp_path / "index" / "v000000000009").mkdir()  # a writer that didn't finish
    assert artifacts.published(spark, path).first().v == 4 and artifacts.versions(spark, path) == ["v000000000003", "v000000000004"]
    assert artifacts.record_usage(rows, str(tmp_path / "usage")) is True
    (tmp_path / "file").write_text("x")
    assert artifacts.record_usage(rows, str(tmp_path / "file" / "usage")) is False


def test_parts_of_a_run_fail_alone(spark):
    def work(part):
        if part == "b":
            raise OSError("no answer")
        return 5, 2, 1

    rows = ingest.run_parts(spark, "r", ["a", "b", "c"], work)
    assert tuple(dml.run_summary(rows).first()) == ("r", 10, 4, 2, "b: no answer", "Completed")
    assert dml.run_summary(ingest.run_parts(spark, "s", ["b"], work)).first().status == "Failed"
