"""Paper records from Atom feeds and OAI-PMH pages, with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import dates, text

_TEXT = T.StringType()


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k.replace("__", ":"), v) for k, v in fields.items()])


_TERM = _s(_term=_TEXT)
ATOM = T.StructType([
    T.StructField("id", _TEXT), T.StructField("title", _TEXT), T.StructField("summary", _TEXT), T.StructField("published", _TEXT), T.StructField("updated", _TEXT),
    T.StructField("author", T.ArrayType(_s(name=_TEXT))), T.StructField("category", T.ArrayType(_TERM)),
    T.StructField("arxiv:primary_category", _TERM), T.StructField("arxiv:comment", _TEXT), T.StructField("arxiv:doi", _TEXT),
    T.StructField("link", T.ArrayType(_s(_href=_TEXT, _rel=_TEXT, _title=_TEXT))),
])
_FEED = T.StructType([T.StructField("opensearch:totalResults", T.ArrayType(_TEXT))])
_NAME = _s(keyname=_TEXT, forenames=_TEXT)
_BODY = _s(id=_TEXT, created=_TEXT, updated=_TEXT, authors=_s(author=T.ArrayType(_NAME)), title=_TEXT, categories=_TEXT, comments=_TEXT, doi=_TEXT, abstract=_TEXT)
OAI = _s(header=_s(_status=_TEXT, identifier=_TEXT, datestamp=_TEXT), metadata=_s(arXiv=_BODY))
_RECORDS = _s(ListRecords=_s(record=T.ArrayType(OAI)))
OAI_PAGE = T.StructType([T.StructField("error", T.ArrayType(_s(_code=_TEXT, _VALUE=_TEXT))), T.StructField("ListRecords", _s(resumptionToken=_s(_completeListSize=T.LongType(), _VALUE=_TEXT)))])


def _read(spark: SparkSession, path: str, row: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def _first(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds (lectern.schemas.ENTRY); those without an id or without /abs/ in it go.

    The primary category comes first in categories. An entry without an update time was last updated when published.
    """
    raw = _read(spark, path, "entry", ATOM)
    found = raw.where(F.coalesce(F.trim("id"), F.lit("")).contains("/abs/")).withColumn("v", text.versioned_id(F.regexp_extract(F.trim("id"), "/abs/(.+)$", 1)))
    terms = F.filter(F.coalesce(F.col("category._term"), F.array().cast("array<string>")), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    primary = _first(F.col("`arxiv:primary_category`._term"), F.try_element_at(terms, F.lit(1)), F.lit("unknown"))
    when = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    comment = F.coalesce(F.col("`arxiv:comment`"), F.lit(""))
    link = lambda test, default: F.coalesce(F.try_element_at(F.filter("link", test), F.lit(1))["_href"], default)
    ident = F.concat(F.col("v.id"), F.lit("v"), F.col("v.version").cast("string"))
    return found.select(
        F.col("v.id").alias("arxiv_id"), F.col("v.version").alias("version"), text.collapsed(F.col("title")).alias("title"), text.collapsed(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: text.collapsed(a["name"])).alias("authors"), primary.alias("primary_category"), F.array_distinct(F.concat(F.array(primary), terms)).alias("categories"),
        when("published").alias("published_utc"), F.coalesce(when("updated"), when("published")).alias("updated_utc"),
        link(lambda x: x["_rel"] == "alternate", F.concat(F.lit("http://arxiv.org/abs/"), ident)).alias("abs_url"), link(lambda x: x["_title"] == "pdf", F.concat(F.lit("http://arxiv.org/pdf/"), ident)).alias("pdf_url"),
        F.trim("`arxiv:doi`").alias("doi"), F.coalesce(text.code_url(comment), text.code_url(F.coalesce("summary", F.lit("")))).alias("code_url"),
    )


class NotAFeed(ValueError):
    """A document whose root is no feed."""


def atom_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(totals, entries) of Atom feeds: totals (file, total) as each feed states it, and atom_entries. A document without a
    feed as its root is an error."""
    feeds = _read(spark, path, "feed", _FEED).select(F.col("_metadata.file_path").alias("file"), F.try_element_at(F.col("`opensearch:totalResults`"), F.lit(1)).try_cast("int").alias("total"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    odd = files.join(feeds.select("file").distinct(), F.regexp_replace(files["file"], "^file:/+", "/") == F.regexp_replace(feeds["file"], "^file:/+", "/"), "left_anti").first()
    if odd is not None:
        raise NotAFeed(f"{odd.file} has no feed as its root")
    return feeds, atom_entries(spark, path)


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of OAI-PMH pages (lectern.schemas.ENTRY, version 1); deleted ones go. Of several DOIs the first counts."""
    return _oai_entries(_read(spark, path, "record", OAI))


def oai_records_of(pages: DataFrame, body: str = "body") -> DataFrame:
    """oai_records of pages in a column of text, each parsed where it is; what is no page has no records."""
    parsed = pages.select(F.from_xml(F.col(body), _RECORDS.simpleString()).alias("page"))
    return _oai_entries(parsed.select(F.inline("page.ListRecords.record")))


def _oai_entries(records: DataFrame) -> DataFrame:
    raw = records.where(F.coalesce("header._status", F.lit("")) != "deleted").select("metadata.arXiv.*").where("id is not null")
    codes = F.filter(F.split(text.collapsed(F.coalesce("categories", F.lit(""))), " "), lambda c: c != "")
    primary = F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("unknown"))
    created = dates.parsed_day(F.trim("created"))
    return raw.select(
        F.trim("id").alias("arxiv_id"), F.lit(1).alias("version"), text.collapsed(F.col("title")).alias("title"), text.collapsed(F.col("abstract")).alias("abstract"),
        F.transform("authors.author", lambda a: text.author_name(a["forenames"], a["keyname"])).alias("authors"), primary.alias("primary_category"), codes.alias("categories"),
        created.alias("published_utc"), F.coalesce(dates.parsed_day(F.trim("updated")), created).alias("updated_utc"),
        F.concat(F.lit("http://arxiv.org/abs/"), F.trim("id")).alias("abs_url"), F.concat(F.lit("http://arxiv.org/pdf/"), F.trim("id")).alias("pdf_url"),
        F.try_element_at(F.split(F.trim("doi"), " "), F.lit(1)).alias("doi"),
        F.coalesce(text.code_url(F.coalesce("comments", F.lit(""))), text.code_url(F.coalesce("abstract", F.lit("")))).alias("code_url"),
    )


def oai_pages(spark: SparkSession, path: str) -> DataFrame:
    """(token, complete_size, error) of each page: an empty token is null, and so is the error noRecordsMatch."""
    raw = _read(spark, path, "OAI-PMH", OAI_PAGE)
    codes = F.filter(F.coalesce(F.col("error._code"), F.array().cast("array<string>")), lambda c: c != "noRecordsMatch")
    token = F.trim("ListRecords.resumptionToken._VALUE")
    return raw.select(F.when(token != "", token).alias("token"), F.col("ListRecords.resumptionToken._completeListSize").alias("complete_size"), F.try_element_at(codes, F.lit(1)).alias("error"))
