import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, jsons, text, vectors
from lectern.plans import accounts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_and_anchors(spark):
    assert one(spark, text.tokens(F.lit("Wind-Driven Kites [WDK]: a 7-fold gain, x & ÉTÉ 42"))) == ["wind", "driven", "kites", "wdk", "fold", "gain", "été", "42"]
    assert one(spark, text.split_anchors(F.lit("tidal power, kelp farms; no\nice cores"))) == ["tidal power", "kelp farms", "ice cores"]
    assert one(spark, text.split_anchors(F.lit("only one topic"))) == ["only one topic"]
    assert len(one(spark, text.split_anchors(F.lit(",".join(f"topic{k}" for k in range(30)))))) == 20


def test_code_links(spark):
    assert one(spark, text.code_url(F.lit("Code: https://github.com/a/b. More"))) == "https://github.com/a/b"
    assert one(spark, text.code_url(F.lit("at HTTPS://www.GitLab.com/x/y, and"))) == "HTTPS://www.GitLab.com/x/y"
    assert one(spark, text.code_url(F.lit("no link"))) is None
    assert one(spark, text.code_url(F.lit("https://example.org/a"))) is None
    assert one(spark, text.code_url(F.lit("https://github.com/" + "a" * 600))) is None
    assert one(spark, text.github_repo(F.lit("https://github.com/o/r.git"))) == "o/r"
    assert one(spark, text.github_repo(F.lit("https://github.com/o/r/tree/main/x"))) == "o/r"
    assert one(spark, text.github_repo(F.lit("https://github.com/o"))) is None


def test_small_text_functions(spark):
    assert tuple(one(spark, text.versioned_id(F.lit("2401.00001v3")))) == ("2401.00001", 3)
    assert tuple(one(spark, text.versioned_id(F.lit("hep-th/9901001")))) == ("hep-th/9901001", 1)
    assert one(spark, text.author_name(F.lit("Ada M."), F.lit("Lovelace"))) == "Ada M. Lovelace"
    assert one(spark, text.author_name(F.lit(None).cast("string"), F.lit("Plato"))) == "Plato"
    assert one(spark, text.harvest_set(F.lit("q-fin.CP"))) == "q-fin" and one(spark, text.harvest_set(F.lit("astro-ph.GA"))) == "physics:astro-ph"
    assert one(spark, text.slug(F.lit("Hello, World of 7 long long WORDS here"))) == "adopted-hello-world-of-7-long-long"
    assert one(spark, text.normalized_query(F.lit("  A \n b "))) == "a b"
    assert one(spark, text.truncated(F.lit("abcdef"), 3, "…")) == "abc…" and one(spark, text.truncated(F.lit("abc"), 3, "…")) == "abc"
    assert one(spark, text.url_component(F.lit("a b&c"))) == "a%20b%26c"
    assert one(spark, text.code_list(F.lit(" a,b , a,,c"))) == ["a", "b", "c"]
    assert one(spark, text.masked(F.lit("secretkey1234"))) == "...1234"
    h = 2166136261
    for ch in "q-17":
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    assert one(spark, text.fnv1a_32(F.lit("q-17"))) == h


def test_dates(spark):
    assert one(spark, dates.epoch_day(dates.moment("1970-01-02 23:00:00"))) == 1
    assert str(one(spark, dates.cutoff("2024-12-31 06:00:00", 30))) == "2024-12-01 06:00:00"
    assert one(spark, dates.age_days(dates.moment("2024-12-30 12:00:00"), "2024-12-31 00:00:00")) == 0.5
    assert one(spark, dates.age_days(dates.moment("2025-12-30 12:00:00"), "2024-12-31 00:00:00")) == 0.0
    assert one(spark, dates.parsed_day(F.lit("2024-13-01"))) is None
    assert str(one(spark, dates.minute_of(dates.moment("2024-01-01 10:11:12")))) == "2024-01-01 10:11:00"


def test_quantisation_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 37)).astype(np.float32)
    rows[7] = 0
    q, scale = vectors.quantized(rows)
    frame = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "k int, v array<float>")
    for r in frame.select("k", vectors.int8_values(F.col("v")).alias("q"), vectors.int8_scale(F.col("v")).alias("s")).collect():
        assert r.q == q[r.k].tolist() and np.float32(r.s) == scale[r.k]
    assert one(spark, vectors.dot(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [4, 5])))) == 14

def halves():
    """Vectors whose second component is a half of the scale in single precision, and not in double."""
    rng, found = np.random.default_rng(3), []
    for largest in rng.uniform(0.1, 0.6, 400).astype(np.float32):
        scale = np.float32(largest / np.float32(127))
        x = ((np.arange(126) + 0.5) * np.float64(scale)).astype(np.float32)
        odd = (x / scale == np.arange(126, dtype=np.float32) + np.float32(0.5)) & (np.rint(x.astype(np.float64) / np.float64(scale)) != np.rint(x / scale))
        found += [[float(largest), float(x[k])] for k in np.flatnonzero(odd)[:2]]
    return found


def test_quantized_halves(spark):
    rows = halves()
    assert len(rows) > 100
    q, _ = vectors.quantized(np.array(rows, np.float32))
    frame = spark.createDataFrame(list(enumerate(rows)), "k int, v array<float>")
    assert [r.q for r in frame.orderBy("k").select(vectors.int8_values(F.col("v")).alias("q")).collect()] == q.tolist()


def test_blend_and_word_vectors(spark):
    unit = one(spark, vectors.blended_unit(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 0.25))
    assert unit == pytest.approx([0.75 / math.hypot(0.75, 0.25), 0.25 / math.hypot(0.75, 0.25)])
    assert one(spark, vectors.blended_unit(F.array(F.lit(0.0)), F.array(F.lit(0.0)), 0.5)) == [0.0]
    v = one(spark, vectors.word_hash_vector(F.split(F.lit("alpha beta alpha of"), " ")))
    assert sum(x * x for x in v) == pytest.approx(1) and sorted(v)[-1] == pytest.approx(2 / math.sqrt(5))
    assert vectors.stable_hash("ab") == (23 * 31 + 97) * 31 + 98


def test_plans(spark):
    raw = '{"interpretation":"i","anchorText":"a, b","categories":["CS.lg","zz"],"dateWindowDays":0,"requireNoCode":true,"hypotheticalAbstract":" ","intent":" Exploratory "}'
    known = F.array(F.lit("cs.LG"), F.lit("cs.CL"))
    p = one(spark, jsons.checked_plan(jsons.plan_of(F.lit(raw)), known))
    assert (p.categories, p.dateWindowDays, p.requireNoCode, p.hypotheticalAbstract, p.intent) == (["cs.LG"], None, True, None, "exploratory")
    assert one(spark, jsons.checked_plan(jsons.plan_of(F.lit('{"anchorText":" "}')), known)) is None
    other = one(spark, jsons.checked_plan(jsons.plan_of(F.lit('{"anchorText":"x","intent":"adventurous"}')), known))
    assert other.intent is None and other.requireNoCode is False
    assert one(spark, jsons.field_or_blank(F.lit("{broken"), "$.interpretation")) == ""
    assert one(spark, F.to_json(jsons.details(F.lit("oops")))) == "{}"


def test_stamps_and_leases(spark):
    at = dates.moment("2024-03-04 05:06:07")
    assert one(spark, dates.minute_stamp(at)) == "202403040506" and one(spark, dates.day_stamp(at)) == "2024-03-04"
    assert str(one(spark, dates.next_daily(at, 5, 6))) == "2024-03-05 05:06:00" and str(one(spark, dates.next_daily(at, 5, 7))) == "2024-03-04 05:07:00"
    assert one(spark, dates.is_stale(at, "2024-03-04 07:06:08")) is True and one(spark, dates.is_stale(at, "2024-03-04 07:06:07")) is False
    assert one(spark, dates.is_stale(F.lit(None).cast("timestamp_ntz"), "2024-03-04 07:06:07")) is True


def test_codes_urls_and_scores(spark):
    code = one(spark, text.invite_code(F.lit("k")))
    assert len(code) == 8 and set(code) <= set(text.UNAMBIGUOUS) and code != one(spark, text.invite_code(F.lit("l")))
    assert one(spark, text.query_url("http://h", F.lit("a.b"), F.lit("1"), F.lit("2"), F.lit(0), 5)) == "http://h?search_query=cat%3Aa.b%20AND%20submittedDate%3A%5B1%20TO%202%5D&start=0&max_results=5&sortBy=submittedDate&sortOrder=ascending"
    score = lambda x: one(spark, accounts.composite_score(F.lit(x).cast("double")))
    assert (score(101), score(-3), score(12.345678), score(None)) == (100, 0, 12.35, None)


def test_mean_pooling(spark):
    tokens = F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert one(spark, vectors.mean_pooled(tokens, F.array(F.lit(1), F.lit(1), F.lit(0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.mean_pooled(tokens, F.array(F.lit(0), F.lit(0), F.lit(0)))) == [0.0, 0.0]
