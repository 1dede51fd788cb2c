import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import lm_score
from lectern.llm.lm_score import BackoffConfig, _order, counted, hashed_words, score
from lectern.llm.queries import ORACLES, QUERIES
from lectern.llm.shared import settings

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_words string"


def brute(docs, alpha=0.4, unseen=0.5):
    words = [(t or "").lower().split() for _, t in docs]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    total, out = sum(one.values()), []
    for (doc, _), ws in zip(docs, words):
        own1, own2, value, backed = Counter(ws), Counter(zip(ws, ws[1:])), 0.0, 0
        for k, w in enumerate(ws):
            level = max(one[w] - own1[w], unseen) / max(1, total - len(ws))
            if k == 0:
                value += math.log(level)
            elif (n := two[ws[k - 1], w] - own2[ws[k - 1], w]) > 0:
                value += math.log(n / (one[ws[k - 1]] - own1[ws[k - 1]]))
            else:
                value += math.log(alpha * level)
                backed += 1
        out.append((doc, len(ws), backed, round(value, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cfg", [BackoffConfig(order=2), BackoffConfig(order=2, chunk_words=20)])
def test_against_brute_force(spark, cfg):
    docs = [(k, " ".join(f"w{(k * j * j + j) % 11}" for j in range(k % 17))) for k in range(80)]
    docs += [(100, None), (101, " \n"), (102, "w1"), (None, "w1 w2 w1 w2"), (103, "w1 w2 w3"), (103, "w1 w2 w3"), (104, "é w1 É"), (105, "w3 " * 40_000)]
    docs = [(d, t.replace("É", "é") if t else t) for d, t in docs]
    rows = score(spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(5), cfg).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in rows), key=repr) == brute(docs)


def test_alone_and_empty(spark):
    assert score(spark.createDataFrame([], SCHEMA)).collect() == []
    assert score(spark.createDataFrame([(1, "a b", "")], SCHEMA)).first().n_backed_off == 1
    assert score(spark.createDataFrame([(1, None, "")], SCHEMA)).first().log_score == 0.0


def deeper(docs, order, alpha=0.4, unseen=0.5):
    words = [(t or "").lower().split() for _, t in docs]
    grams = lambda ws: Counter(tuple(ws[k : k + n]) for n in range(1, order + 1) for k in range(len(ws) - n + 1))
    every, total, out = sum((grams(ws) for ws in words), Counter()), sum(map(len, words)), []
    for (doc, _), ws in zip(docs, words):
        own, value, backed = grams(ws), 0.0, 0
        rest = lambda g: every[g] - own[g]
        for k in range(len(ws)):
            top = min(order, k + 1)
            n = next((n for n in range(top, 1, -1) if rest(tuple(ws[k - n + 1 : k + 1])) > 0), 1)
            gram = tuple(ws[k - n + 1 : k + 1])
            value += (top - n) * math.log(alpha)
            value += math.log(rest(gram) / rest(gram[:-1])) if n > 1 else math.log(max(rest(gram), unseen) / max(1, total - len(ws)))
            backed += n < top
        out.append((doc, len(ws), backed, round(value, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 3, 5])
def test_longer_contexts(spark, order):
    docs = [(k, " ".join(f"w{(k * j * j + j) % 7}" for j in range(k % 17))) for k in range(80)] + [(100, None), (101, "w1"), (102, "w3 " * 3_000)]
    rows = score(spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(3), BackoffConfig(order=order, chunk_words=60)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in rows), key=repr) == deeper(docs, order)


@pytest.mark.parametrize("name", ["op8_lm_score", "op8_lm_score_order2"])
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = {r[0]: r[1:] for r in db.sql(ORACLES[name]).fetchall()}
    for r in QUERIES[name](spark, SF).collect():
        n, backed, value = expected[r.doc_id]
        assert (r.n_words, r.n_backed_off) == (n, backed) and abs(r.log_score - value) < 2e-4


def test_one_count_table_exchange(spark):
    """The n-grams' rows are dealt by hash once, for the count table and for the join."""
    grams = spark.range(1000).selectExpr("id % 300 AS ngram", "id AS chunk", "1 AS n").mapInArrow(lambda batches: batches, "ngram long, chunk long, n int")
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = counted(grams)._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 2  # one of them is named by the reuse
    assert {(r.ngram, r.others) for r in counted(grams).collect()} == {(k, 3 if k < 100 else 2) for k in range(300)}


def test_answers_are_written_in_few_rows(spark, monkeypatch):
    """What the join finds is a row for each chunk of a task, not one for each n-gram, on the way back to the chunks."""
    found = []

    def spied(df, name, *args, **more):
        out = kept(df, name, *args, **more)
        if name == "known":
            found.append(out.count())
        return out

    kept = lm_score.written
    monkeypatch.setattr(lm_score, "written", spied)
    docs = [(k, " ".join(f"w{(k % 30 * j + j) % 97}" for j in range(200)), "") for k in range(60)]
    score(spark.createDataFrame(docs, SCHEMA).coalesce(1), BackoffConfig(chunk_words=6_000)).collect()
    assert len(found) == 3 and all(0 < rows <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) for rows in found)


def test_answers_in_many_small_pieces(spark, monkeypatch):
    docs = [(k, " ".join(f"w{(k * j * j + j) % 11}" for j in range(k % 17))) for k in range(80)]
    monkeypatch.setattr(lm_score, "_HELD", 1)
    rows = score(spark.createDataFrame([(*d, "") for d in docs], SCHEMA).repartition(5), BackoffConfig(order=2, chunk_words=60)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in rows), key=repr) == brute(docs)


def test_words_are_hashed_together():
    texts = ["a b a", None, "", " \t\n\v\f\r", " Ab\x0bAB aB\r", "abcdefgh abcdefghi abcdefgh\0 a\0 a", "É é\u00a0x \x1c", "x" * 255, "x" * 256, "x" * 257 + " " + "x" * 257 + " " + "x" * 300 + "Y", "q" * 16 + " " + "q" * 17, "z"]
    for kind in (pa.string(), pa.binary()):
        hashes, counts = hashed_words(pa.array([t if t is None else t.encode() for t in texts], pa.binary()).cast(kind))
        words = [(t or "").encode().lower().split() for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        every = [w for ws in words for w in ws]
        assert len(hashes) == len(every) and len(set(zip(every, hashes.tolist()))) == len(set(every)) == len(set(hashes.tolist()))
    assert [x.tolist() for x in hashed_words(pa.array([], pa.string()))] == [[], []]
    assert [x.tolist() for x in hashed_words(pa.array([None, " "], pa.string()))] == [[], [0, 0]]


@pytest.mark.parametrize("keys", [[], [7], [5, 5, 5], [3, 1, 2, 1], list(range(5000, 0, -1)), [2**63 + k % 3 for k in range(50)], [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(3000)] * 2])
def test_order_of_hashes(keys):
    keys = np.array(keys, np.uint64)
    order = _order(keys)
    assert sorted(order.tolist()) == list(range(len(keys))) and keys[order].tolist() == sorted(keys.tolist())
