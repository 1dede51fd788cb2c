"""Training text from raw documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import DecontaminationConfig, contaminated, text_key
from lectern.llm.language_id import UNDETERMINED, LanguageConfig, identify, train
from lectern.llm.minhash_dedup import MinHashConfig, near_duplicates
from lectern.llm.packing import pack
from lectern.llm.queries import packing_config
from lectern.llm.secret_scan import SecretConfig, redact, scan
from lectern.llm.shared import written
from lectern.tables import table

#: Near duplicates share 0.8 of their shingles of five words; the chance to miss such a pair is 1.4e-6.
NEAR = MinHashConfig(words=5, threshold_percent=80, bands=34, rows=5)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1 and so on, so that no name can clash with one of an operator; and the new names."""
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language stays ambiguous.

    Null and empty texts have no letter, so they go. A row is judged by its text alone: a null id, repeated rows and ids
    with several texts change nothing, and rows come out as often and as they went in, whatever their columns are called.
    At equal losses the first language by name is taken, and the text is ambiguous, so it goes. If no row is labelled, no
    language is known and every row goes. No rows give no rows.
    """
    plain, names = _numbered(docs)
    model = train(docs.select("doc_id", "text", "lang"), LanguageConfig())
    found = identify(plain, model, names["text"])
    return found.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select(*names.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the smallest id, rows with a null id last.

    Rows are told apart by a number that is stored with them, not by their id. So a repeated row stays once, of an id with
    several texts each text is judged by itself, and a row with a null id goes if it copies another. Of rows with one id in
    a group the one read first stays. Null and empty texts, and texts without a word, copy nothing and stay. Columns keep
    their names and values. No rows give no rows.
    """
    plain, names = _numbered(docs)
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select("row", F.col(names["text"]).alias("text")), NEAR, "row", "text")
    others = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("first")), "copies")
    members = others.unionByName(others.select(F.col("first").alias("row"), "first").distinct())
    ranked = members.join(rows.select("row", F.col(names["doc_id"]).alias("id")), "row").select("first", F.struct(F.col("id").isNull().alias("null"), "id", "row").alias("key"))
    best = ranked.groupBy("first").agg(F.min("key").alias("best"))
    gone = ranked.select("key.row").join(best.select("best.row"), "row", "left_anti")
    return rows.join(written(gone, "dropped"), "row", "left_anti").select(*names.values()).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    A row's fate depends on its text alone: rows with the same text all go or all stay, also repeated ones and those with
    a null id, and of an id with several texts only those with a passage go. Null and empty texts hold nothing and stay,
    as all rows do if the benchmark is empty. Columns keep their names and values. No rows give no rows.
    """
    plain, names = _numbered(docs)
    text = F.col(names["text"])
    found = contaminated(plain.select(F.monotonically_increasing_id().alias("row"), text.alias("text")), table(spark, sf_dir, "benchmark"), DecontaminationConfig(), "row", "text")
    gone = written(found.select("text_key.*").distinct().select(F.col("hash").alias("gone_hash"), F.col("check").alias("gone_check")), "dropped")
    key = text_key(text)
    kept = plain.join(gone, (key["hash"] == F.col("gone_hash")) & (key["check"] == F.col("gone_check")), "left_anti")
    return kept.select(*names.values()).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; n_chars follows the text.

    All rows stay, repeated ones and those with a null id too: secrets are found and replaced by a row's text. Where spans
    overlap, the one that starts first names the whole. Null texts stay null with their n_chars, empty ones empty. Other
    columns keep their names and values. No rows give no rows.
    """
    plain, names = _numbered(docs)
    found = scan(plain.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text")), SecretConfig())
    clean = redact(plain, found, names["text"])
    if "n_chars" in names:
        text, n = names["text"], names["n_chars"]
        clean = clean.withColumn(n, F.when(F.col(text).isNotNull(), F.length(text).cast(dict(plain.dtypes)[n])).otherwise(F.col(n)))
    return clean.select(*names.values()).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens.

    Every row is packed, repeated ones as often as they come and those with a null id as such; a null or empty text is its
    end token alone. Of windows with equal gaps the one opened first is filled. Other columns don't matter. No rows give no
    pieces.
    """
    return pack(docs, packing_config())


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: Fitted models, sketches and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
