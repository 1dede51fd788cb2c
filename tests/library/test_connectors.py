import json

import pytest

from lectern.sources import connectors

CALLS = []


def live(token):
    """A service of four pages, busy at the second call."""
    CALLS.append(token)
    if len(CALLS) == 2:
        raise connectors.Busy(0.01)
    n = 0 if token is None else int(token)
    return f"body {n}", str(n + 1) if n < 3 else None


def test_a_live_harvest_is_not_fetched_twice(spark, tmp_path):
    reader = connectors._HarvestReader(str(tmp_path / "pages"), "tests.library.test_connectors:live", 2)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert first == {"token": "1", "done": False} and CALLS == [None]
    second = reader.latestOffset()
    assert second["token"] == "2" and CALLS == [None, "1", "1"]
    again = connectors._HarvestReader(str(tmp_path / "pages"), "tests.library.test_connectors:live", 2)  # after a failure before the commit
    assert again.latestOffset()["token"] == "3" and CALLS == [None, "1", "1", "2"]
    end = again.latestOffset()
    assert end["done"] and again.latestOffset() == end and CALLS[-1] == "3" and len(CALLS) == 5
    parts = again.partitions(start, end)
    assert [len(p.value) for p in parts] == [2, 2]
    assert [row for p in parts for row in again.read(p)] == [("", "body 0"), ("1", "body 1"), ("2", "body 2"), ("3", "body 3")]
    assert [r for p in again.partitions(second, end) for r in again.read(p)] == [("2", "body 2"), ("3", "body 3")]


def test_each_recorded_file_is_opened_once(tmp_path):
    lines = [json.dumps({"token": "" if k == 0 else f"t{k}", "next": f"t{k + 1}" if k < 59 else None, "body": f"b{k}"}) for k in range(60)]
    for k in range(6):
        (tmp_path / f"p{k}").write_text("\n".join(lines[k::6]) + "\n")
    reader = connectors._HarvestReader(str(tmp_path), None, 7)
    assert reader.latestOffset()["done"] and len(reader.seen) == 6
    assert [b for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for _, b in reader.read(p)] == [f"b{k}" for k in range(60)]


def service(category, since, until, start, size, options):
    total = {"a": 7, "b": 0, "c": 250}[category]
    return total, [f"{category}{since}{k}" for k in range(start, min(total, start + size))]


def test_pages_as_partitions_equal_the_sequence(spark):
    spark.dataSource.register(connectors.PagedService)
    options = {"fetch": "tests.library.test_connectors:service", "categories": "a,b,c", "since": "-", "size": 20, "lanes": 3}
    rows = spark.read.format("paged_service").options(**options).load().collect()
    sequence = lambda c: [e for page in connectors.paged(lambda *x: service(*x, {}), c, "-", "", 20) for e in page]
    for c in "abc":
        assert [r.entry for r in sorted(rows, key=lambda r: r.start) if r.category == c] == sequence(c)
    assert len({r.start for r in rows if r.category == "c"}) == 13


def test_batches_by_length(spark):
    pairs = spark.createDataFrame([(k % 3, k, "q" * (k % 3), "p" * (k * 37 % 101)) for k in range(200)] + [(9, 9, None, None)], "query_id long, paper_id long, query string, passage string")
    got = connectors.scored_by_length(pairs, lambda batch: [len(q) * 1000.0 + len(p) for q, p in batch], 8, 2).collect()
    assert {(r.query_id, r.paper_id): r.score for r in got} == {(k % 3, k): (k % 3) * 1000.0 + k * 37 % 101 for k in range(200)} | {(9, 9): 0.0}
    assert max(r.padded for r in got) < 30
    with pytest.raises(Exception, match="came back"):
        connectors.scored_by_length(pairs, lambda batch: [1.0], 8).collect()
