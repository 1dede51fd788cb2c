import corpus_pipeline
from pyspark.sql import functions as F

from lectern.llm.shared import written
from lectern.tables import table
from tests.llm.test_decontaminate import SF
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check
from tests.llm.test_secrets import base


def test_every_stage_takes_effect(spark):
    docs = table(spark, SF, "documents")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == names
    language = kept["language_id"].collect()
    assert len(language) >= 990
    near = brute([(r.doc_id, r.text) for r in language], 80)
    assert {r.doc_id for r in kept["minhash_dedup"].collect()} == {i for i, (_, c) in near.items() if i == c}
    bench = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    leak = lambda t: any(b in " ".join(t.lower().split()) for b in bench)
    clean = {r.doc_id: r for r in kept["decontaminate"].collect()}
    assert set(clean) == {r.doc_id for r in kept["minhash_dedup"].collect() if not leak(r.text)}
    for r in kept["secret_scan"].collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(clean[r.doc_id].text):
            assert r.text == clean[r.doc_id].text
    assert check(kept["packing"].collect(), [(r.doc_id, r.text) for r in kept["secret_scan"].collect()]) == 0


def test_documents_with_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat and the dog", None, None, 19), (3, "the cat and the dog", "en", "s", 19), (4, "### 12", "en", "s", 6)] + [(k, f"the quick {k} fox and token=abcdef{k} is here", "en", "s", 44) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} == {None, 3, *range(10, 30)}
    assert docs.count() > 0
    assert not corpus_pipeline.ORACLE_SQL


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(spark, name, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in stage(name)(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()), key=repr)


def test_near_copies_are_told_apart_by_row(spark):
    long, other = " ".join(WORDS), " ".join(reversed(WORDS))
    near = long.replace("wca", "new")
    rows = [(1, long), (1, long), (2, near), (5, long), (5, other), (None, long), (None, "a text of its own that nobody copies"), (7, None), (7, None), (8, ""), (9, "x " * 60_000), (10, "x " * 60_001)]
    kept = rows_of(spark, "minhash_dedup", [(d, t, None, "s", None) for d, t in rows])
    expected = [(1, long), (5, other), (None, rows[6][1]), (7, None), (7, None), (8, ""), (9, rows[10][1])]
    assert kept == sorted(((d, t, None, "s", None) for d, t in expected), key=repr)
    only_nulls = rows_of(spark, "minhash_dedup", [(None, long, None, None, None)] * 3)
    assert only_nulls == [(None, long, None, None, None)]


def test_contaminated_rows_with_any_id_go(spark):
    item = table(spark, SF, "benchmark").first().text
    rows = [(1, f"x {item}"), (None, f"x {item}"), (2, "clean text"), (2, f"y {item}"), (2, "clean text"), (None, "clean text"), (3, None), (4, ""), (5, "word " * 100_000 + item)]
    kept = rows_of(spark, "decontaminate", [(d, t, None, None, None) for d, t in rows])
    assert kept == sorted(((d, t, None, None, None) for d, t in [(2, "clean text"), (2, "clean text"), (None, "clean text"), (3, None), (4, "")]), key=repr)


def test_clashing_columns_keep_their_values(spark):
    docs = table(spark, SF, "documents").limit(300)
    own = ["score", "lang_pred", "ambiguous", "row", "kept", "blob", "_blob", "_kinds", "hash", "component_id", "c0", "text_key"]
    wide = docs
    for k, name in enumerate(own):
        wide = wide.withColumn(name, F.lit(f"own {k}"))
    wide = written(wide, "wide")
    for name, f in corpus_pipeline.STAGES[:-1]:
        wide = written(f(spark, wide, SF), name)
        assert wide.columns == [*docs.columns, *own] and not wide.isEmpty()
        assert [tuple(r) for r in wide.select(*own).distinct().collect()] == [tuple(f"own {k}" for k in range(len(own)))]


def test_secrets_by_text(spark):
    rows = [(1, "token=abcdef12 x", 3), (1, "token=abcdef12 x", 3), (None, "password: hunter22", None), (2, None, 9), (3, "", 0), (4, "a " * 50_000 + "secret=qwertyu", 1)]
    found = rows_of(spark, "secret_scan", [(d, t, None, None, n) for d, t, n in rows])
    clean = [(1, "[assign] x", 10), (1, "[assign] x", 10), (None, "[assign]", 8), (2, None, 9), (3, "", 0), (4, "a " * 50_000 + "[assign]", 100_008)]
    assert found == sorted(((d, t, None, None, n) for d, t, n in clean), key=repr)


def test_language_of_rows(spark):
    rows = [(k, f"the quick fox of day {k} and the dog", "en", None, None) for k in range(40)] + [(k, f"le renard du jour {k} et les chiens de la rue", "fr", None, None) for k in range(40, 80)]
    rows += [(None, "the dog and the fox", None, None, None), (1, rows[1][1], "en", None, None), (90, None, "en", None, None), (91, "", "en", None, None), (92, "12 !", "fr", None, None), (93, "les chiens " * 20_000, None, None, None)]
    kept = rows_of(spark, "language_id", rows)
    assert kept == sorted((r for r in rows if r[0] not in (90, 91, 92)), key=repr)
    assert rows_of(spark, "language_id", [(1, "no label here", None, None, None)]) == []


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, SF), name)
        assert docs.isEmpty()
