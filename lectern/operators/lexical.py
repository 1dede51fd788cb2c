"""Postings, corpus statistics and BM25 for any number of queries at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import dates, text
from lectern.operators import dml
from lectern.sources.artifacts import publish, published
from lectern.tables import CLEANED, settings, stored

K1, B = 1.2, 0.75
MOST_TF = 255


def postings(papers: DataFrame) -> DataFrame:
    """(term, paper_id, tf): a row for each term of a title and abstract; counts stop at 255."""
    words = papers.select("paper_id", F.explode(text.tokens(text.document_text(F.col("title"), F.col("abstract"), " "))).alias("term"))
    return words.groupBy("term", "paper_id").agg(F.least(F.count("*"), F.lit(MOST_TF)).cast("int").alias("tf"))


def lengths(papers: DataFrame) -> DataFrame:
    """(paper_id, dl, epoch_day) for every paper, also one without a term."""
    count = F.size(text.tokens(text.document_text(F.col("title"), F.col("abstract"), " ")))
    return papers.select("paper_id", count.alias("dl"), dates.epoch_day(F.col("published_utc")).alias("epoch_day"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: n papers, and their mean length over all of them (1 for none)."""
    return doc_lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) for the distinct terms of queries (query_id, query_text)."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query_text")))).alias("term"))


#: Stands for no word of a text, in a row that each paper has.
_NO_WORD = ""


def bm25(papers: DataFrame, queries: DataFrame, top: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, paper_id, score, rank): the best `top` papers of each query, the smaller id first at equal scores.

    Frequencies and lengths are those of the whole corpus, also if only some papers are allowed. Texts are read once, and words that
    no query has are dropped there. What moves is a paper's other words, to where the paper is summed for all queries: weights and
    sums stay there, and of these only each part's best of a query go on.
    """
    wanted = stored(query_terms(queries), "wanted")
    words = wanted.select("term").distinct().unionByName(papers.sparkSession.createDataFrame([(_NO_WORD,)], "term string"))
    words = stored(words.withColumn("word", F.monotonically_increasing_id()), "words")
    body = _parsed(papers).select("paper_id", F.size("ts").alias("dl"), F.explode(F.concat(F.array(F.lit(_NO_WORD)), F.coalesce("ts", F.array().cast("array<string>")))).alias("term"))
    dealt = body.join(words, "term").select("paper_id", "dl", "word").repartition("paper_id")
    hits = stored(dealt.groupBy("paper_id", "dl", "word").agg(F.least(F.count("*"), F.lit(MOST_TF)).cast("int").alias("tf")), "hits")
    none = F.broadcast(words.where(F.col("term") == _NO_WORD).select("word"))  # one row
    stats = corpus_stats(hits.join(none, "word", "left_semi"))  # one row
    frequency = hits.groupBy("word").agg(F.count("*").alias("df"))
    known = stored(wanted.join(words, "term").join(frequency, "word").select("query_id", "word", "df"), "known")
    kept = hits if allowed is None else hits.join(allowed.select("paper_id"), "paper_id", "left_semi")
    return best_of(_summed(_met(kept, known, ["word"], stats)), top)


def _met(hits: DataFrame, known: DataFrame, on: list[str], stats: DataFrame) -> DataFrame:
    """(query_id, paper_id, w) of hits that match known: hits are dealt by paper before they are multiplied by queries, so that their
    weights needn't move to be summed."""
    dealt = hits.select("paper_id", *on, "tf", "dl").repartition("paper_id")
    return dealt.join(known, on).join(F.broadcast(stats)).select("query_id", "paper_id", _weight().alias("w"))


def _weight():
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("query_id", "paper_id").agg(F.sum("w").alias("score"))


def best_of(sums: DataFrame, top: int | None) -> DataFrame:
    """The `top` best of each query's sums (query_id, paper_id, score), with their rank."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "paper_id")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("query_id", "paper_id", "score", "rank")


BUCKETS = 64
#: Postings are written in a slice for each so many words, up to so many slices.
SLICE_WORDS, MOST_SLICES = 1 << 24, 8
#: Distinct terms up to which a search names them to the scan; more are joined.
MOST_NAMED = 1_000
#: Ids of papers to a block of a term's postings, each of which has bounds.
BLOCK = 256
#: A search for the best k first weighs a query's weightiest terms, until they have this many times k postings.
PROBED = 4
#: Scores are ranked as rounded to nine places; a paper this far below the k-th isn't among the best.
_SLACK = 1e-8


@dataclass(frozen=True)
class LexicalIndex:
    """What a search reads, over all segments of an index: postings (segment, bucket, term, paper_id, tf, dl), stored by bucket and
    sorted by term and paper; terms (term, df); stats (n, avgdl), one row; gone (segment, paper_id), rows that later segments replace; bounds (bucket, term, block, tf, slim), each block's largest tf and
    smallest dl / tf."""

    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    stats: DataFrame
    gone: DataFrame
    segments: int


_POSTING = "bucket int, term string, paper_id long, tf int, dl int"
_BOUND = "bucket int, term string, block long, tf int, slim double"
_FORWARD = "paper_id long, dl int, terms array<string>"
_LIST = "segment string, n long, total long, papers long"
_GONE = "segment string, paper_id long"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block():
    return F.floor(F.col("paper_id") / BLOCK)


def _write_bounds(spark: SparkSession, root: str) -> None:
    """Bounds of a segment's blocks. A weight grows with tf and falls with dl / tf, so they hold whatever later segments make of n and avgdl."""
    each = spark.read.schema(_POSTING).parquet(f"{root}/postings").groupBy("bucket", "term", _block().alias("block"))
    bounds = each.agg(F.max("tf").alias("tf"), F.min(F.col("dl") / F.col("tf")).alias("slim"))
    with settings(spark, CLEANED):
        bounds.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{root}/bounds")


def _write_postings(rows: DataFrame, words: int, root: str, count: bool) -> None:
    """Postings of a segment from rows (term, paper_id, tf, dl), or (term, paper_id, dl) with a row for each occurrence if they are to
    be counted; words: how many rows, about. They are written some buckets at a time, so that what is shuffled is a slice of them."""
    slices, rows = 1 + min(MOST_SLICES - 1, words // SLICE_WORDS), rows.withColumn("bucket", _bucket("term"))
    for k in range(slices):
        own = rows.where(F.col("bucket") % slices == k)
        if count:
            own = own.groupBy("bucket", "term", "paper_id", "dl").agg(F.least(F.count("*"), F.lit(MOST_TF)).cast("int").alias("tf"))
        dealt = own.select(*_names(_POSTING)).repartitionByRange("bucket", "term", "paper_id").sortWithinPartitions("bucket", "term", "paper_id")
        with settings(rows.sparkSession, CLEANED):
            dealt.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")


def _parsed(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", text.tokens(text.document_text(F.col("title"), F.col("abstract"), " ")).alias("ts"))


def _segment(papers: DataFrame, root: str) -> DataFrame:
    """Write the postings of papers, and their terms by paper; returns the latter. Postings are dealt by range of bucket, term and
    paper, so that a term that every paper has is in many files."""
    spark = papers.sparkSession
    with settings(spark, CLEANED):
        _parsed(papers).select("paper_id", F.size("ts").alias("dl"), F.col("ts").alias("terms")).write.option("compression", "zstd").parquet(f"{root}/papers")
    forward = spark.read.schema(_FORWARD).parquet(f"{root}/papers")
    words = forward.agg(F.sum("dl")).first()[0] or 0
    _write_postings(forward.select("paper_id", "dl", F.explode("terms").alias("term")), words, root, count=True)
    _write_bounds(spark, root)
    return forward


def _frequencies(forward: DataFrame, sign: int) -> DataFrame:
    return forward.select("paper_id", F.explode(F.array_distinct("terms")).alias("term")).select("term", F.lit(sign).cast("long").alias("df"))


def build_index(papers: DataFrame, path: str) -> None:
    """A new index of papers in place of the one at a path, as one segment. Readers see it once all of it is written."""
    spark, name = papers.sparkSession, f"s{uuid.uuid4().hex}"
    forward = _segment(papers, f"{path}/{name}")
    with settings(spark, CLEANED):
        spark.read.schema(_POSTING).parquet(f"{path}/{name}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/{name}/terms")
    sums = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    _publish(spark, path, sums.select(F.lit(name).alias("segment"), "n", "total", F.col("n").alias("papers")), None)


def update_index(spark: SparkSession, path: str, page: DataFrame, removed: DataFrame | None = None) -> None:
    """The index at a path after an upsert of page, and without the papers (paper_id) of removed: a new segment.

    Only the page is parsed. Papers that an earlier segment has are marked as gone there, and their terms, which it keeps by
    paper, are taken off the frequencies: a segment's counts are what it adds less what it replaces, so they sum up.
    """
    listed, gone = _listed(spark, path)
    name = f"s{uuid.uuid4().hex}"
    forward = _segment(dml.first_of_page(page.select("paper_id", "title", "abstract"), "paper_id"), f"{path}/{name}")
    changed = forward.select("paper_id") if removed is None else forward.select("paper_id").unionByName(removed.select("paper_id")).distinct()
    changed = stored(changed, "changed")
    old = [spark.read.schema(_FORWARD).parquet(f"{path}/{r.segment}/papers").select(F.lit(r.segment).alias("segment"), *_names(_FORWARD)) for r in listed]
    live = reduce(DataFrame.unionByName, old).join(gone, ["segment", "paper_id"], "left_anti")
    replaced = stored(live.join(changed, "paper_id", "left_semi"), "replaced")
    frequencies = _frequencies(forward, 1).unionByName(_frequencies(replaced, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    frequencies.write.parquet(f"{path}/{name}/terms")
    added, less = (df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")) for df in (forward, replaced))
    less = less.select(F.col("n").alias("_n"), F.col("total").alias("_total"))
    row = added.crossJoin(less).select(F.lit(name).alias("segment"), (F.col("n") - F.col("_n")).alias("n"), (F.col("total") - F.col("_total")).alias("total"), F.col("n").alias("papers"))
    _publish(spark, path, spark.createDataFrame(listed, _LIST).unionByName(row), gone.unionByName(replaced.select("segment", "paper_id")))


def compact_index(spark: SparkSession, path: str, most: int = 8) -> bool:
    """Merge all segments into one if there are more than `most`: postings of papers that are gone are left out, no text is parsed."""
    listed, gone = _listed(spark, path)
    if len(listed) <= most:
        return False
    index, name = open_index(spark, path), f"s{uuid.uuid4().hex}"
    live = index.postings.join(gone, ["segment", "paper_id"], "left_anti").select(*_names(_POSTING))
    _write_postings(live.drop("bucket"), sum(r.total for r in listed), f"{path}/{name}", count=False)
    _write_bounds(spark, f"{path}/{name}")
    old = [spark.read.schema(_FORWARD).parquet(f"{path}/{r.segment}/papers").select(F.lit(r.segment).alias("segment"), *_names(_FORWARD)) for r in listed]
    reduce(DataFrame.unionByName, old).join(gone, ["segment", "paper_id"], "left_anti").select(*_names(_FORWARD)).write.parquet(f"{path}/{name}/papers")
    index.terms.write.parquet(f"{path}/{name}/terms")
    n, total = sum(r.n for r in listed), sum(r.total for r in listed)
    _publish(spark, path, spark.createDataFrame([(name, n, total, n)], _LIST), None)
    return True


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _publish(spark: SparkSession, path: str, listed: DataFrame, gone: DataFrame | None) -> None:
    """A new list of segments. The tables of gone rows and of segments get names of their own; the list, one file, makes them seen."""
    mark = uuid.uuid4().hex
    (spark.createDataFrame([], _GONE) if gone is None else gone).write.parquet(f"{path}/gone-{mark}")
    publish(spark, f"{path}/lists", listed.withColumn("gone", F.lit(mark)).coalesce(1))


def _listed(spark: SparkSession, path: str) -> tuple[list[Row], DataFrame]:
    """The newest list of segments, a row for each of a bounded number, and the rows gone from them."""
    rows = published(spark, f"{path}/lists").orderBy("segment").collect()
    return [Row(**{k: r[k] for k in _names(_LIST)}) for r in rows], spark.read.schema(_GONE).parquet(f"{path}/gone-{rows[0]['gone']}")


def open_index(spark: SparkSession, path: str) -> LexicalIndex | None:
    """A stored index; None if there is none that was finished."""
    if published(spark, f"{path}/lists") is None:
        return None
    listed, gone = _listed(spark, path)
    each = [spark.read.schema(_POSTING).parquet(f"{path}/{r.segment}/postings").select(F.lit(r.segment).alias("segment"), *_names(_POSTING)) for r in listed]
    terms = [spark.read.schema("term string, df long").parquet(f"{path}/{r.segment}/terms") for r in listed]
    n, total = sum(r.n for r in listed), sum(r.total for r in listed)
    frequencies = terms[0] if len(terms) == 1 else reduce(DataFrame.unionByName, terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    bounds = [spark.read.schema(_BOUND).parquet(f"{path}/{r.segment}/bounds") for r in listed]
    return LexicalIndex(reduce(DataFrame.unionByName, each), reduce(DataFrame.unionByName, bounds), frequencies, spark.createDataFrame([(n, total / n if n else 1.0)], "n long, avgdl double"), gone, len(listed))


def _asked(index: LexicalIndex, queries: DataFrame) -> tuple[DataFrame, LexicalIndex]:
    """(query_id, term, df, bucket) of terms that the index has, and the index as far as it is about them.

    The queries' terms, up to MOST_NAMED distinct ones, are named to the scan, which then opens the folders of their buckets and the
    row groups that can hold them; more are joined.
    """
    wanted = stored(query_terms(queries), "terms")
    named = [r.term for r in wanted.select("term").distinct().limit(MOST_NAMED + 1).collect()]
    if len(named) <= MOST_NAMED:
        buckets = [r.b for r in wanted.select(_bucket("term").alias("b")).distinct().collect()]
        own = F.col("bucket").isin(buckets) & F.col("term").isin(named)
        index = replace(index, postings=index.postings.where(own), bounds=index.bounds.where(own), terms=index.terms.where(F.col("term").isin(named)))
    return wanted.join(index.terms, "term").withColumn("bucket", _bucket("term")), index


def _kept(index: LexicalIndex, hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Hits without those that later segments replace, of allowed papers."""
    if index.segments > 1:
        hits = hits.join(index.gone, ["segment", "paper_id"], "left_anti")
    return hits if allowed is None else hits.join(allowed.select("paper_id"), "paper_id", "left_semi")


def search_sums(index: LexicalIndex, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, paper_id, score) of every paper that shares a term with a query."""
    known, index = _asked(index, queries)
    known, on = stored(known, "known"), ["bucket", "term"]
    hits = _kept(index, index.postings.join(known.select(*on), on, "left_semi"), allowed)
    return _summed(_met(hits, known, on, index.stats))


def search_index(index: LexicalIndex, queries: DataFrame, top: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """bm25 from a stored index."""
    return best_of(search_sums(index, queries, allowed), top)


def _most():
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * (K1 + 1) / (1 + K1 * (1 - B) / F.col("tf") + K1 * B * F.col("slim") / F.col("avgdl"))


def pruned_weights(index: LexicalIndex, queries: DataFrame, top: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, paper_id, w): the weights of all terms of every paper that can be among a query's `top` best; and those that were
    weighed to find the scores they have to reach.

    A query's weightiest terms are weighed first, and the best papers by these in full: the `top`-th of their scores is one that
    the best reach. A block of ids in which the bounds of all terms stay below it together brings in no paper; postings of the
    others are dealt by block, so a term that every paper has is spread over tasks, and are summed there for all queries. Only
    papers that come up to the `top`-th of these sums are weighed in rows. A query with fewer than `top`
    papers in its first terms has all its terms weighed.
    """
    known, index = _asked(index, queries)
    known, stats, keys = stored(known, "known"), F.broadcast(index.stats), ["query_id", "paper_id"]
    # the queries' own postings, read once
    hits = _kept(index, index.postings.join(known.select("bucket", "term"), ["bucket", "term"], "left_semi"), allowed)
    hits = stored(hits.select("term", "paper_id", "tf", "dl"), "hits")

    def weighed(wanted: DataFrame, on: list[str], of: DataFrame) -> DataFrame:
        return of.join(wanted, on).join(stats).select(*keys, _weight().alias("w"))

    caps = index.bounds.join(known, ["bucket", "term"]).join(stats).groupBy("query_id", "bucket", "term", "df", "block").agg(F.max(_most()).alias("most"))
    caps = stored(caps, "caps")
    order = W.partitionBy("query_id").orderBy(F.desc("most"), "term")
    terms = caps.groupBy("query_id", "bucket", "term", "df").agg(F.max("most").alias("most"))
    before = F.coalesce(F.sum("df").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    terms = stored(terms.select("query_id", "term", "df", before.alias("before")), "terms")

    def weighed_papers(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        rows = pairs.join(wanted.select("query_id", "term", "df"), "query_id")
        return weighed(rows, ["term", "paper_id"], hits.join(pairs.select("paper_id"), "paper_id", "left_semi"))

    probe = stored(weighed(terms.where(F.col("before") < PROBED * top).select("query_id", "term", "df"), ["term"], hits), "probe")
    likely = stored(best_of(_summed(probe), top).select(*keys), "likely")
    full = stored(weighed_papers(likely, terms), "full")
    reach = _summed(full).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score") - _SLACK).alias("reach"))
    reach = stored(terms.select("query_id").distinct().join(reach, "query_id", "left").select("query_id", F.coalesce("reach", F.lit(0.0)).alias("reach")), "reach")

    open_ = stored(caps.groupBy("query_id", "block").agg(F.sum("most").alias("most")).join(reach, "query_id").where("most >= reach").select("query_id", "block", "reach"), "open")
    leading = caps.select("query_id", "block", "term").join(open_, ["query_id", "block"])
    each = hits.withColumn("block", _block()).join(open_.select("block").distinct(), "block", "left_semi")
    each = each.join(stored(terms.select("term", "df").distinct(), "words"), "term").join(stats).select("block", "term", "paper_id", _weight().alias("w"))
    may = stored(each.groupBy("block").cogroup(leading.groupBy("block")).applyInArrow(_reaching, f"query_id {dict(queries.dtypes)['query_id']}, paper_id long, score double"), "may")
    # the best of these sums are least scores too, and mostly far higher ones
    best = best_of(may, top).groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score") - _SLACK).alias("higher"))
    may = may.join(best, "query_id", "left").where(F.col("higher").isNull() | (F.col("score") >= F.col("higher")))
    return weighed_papers(stored(may.select(*keys), "may"), terms), probe.unionByName(full)


#: Rows of a block's papers that are summed at once.
_AT_ONCE = 1 << 14


def _reaching(hits: pa.Table, leading: pa.Table) -> pa.Table:
    """(query_id, paper_id, score): of a block's papers those whose weights, of hits (block, term, paper_id, w), sum up to what a query
    has to reach; leading has (query_id, block, term, reach), a query's terms in the block."""
    known = pa.chunked_array([*hits["term"].chunks, *leading["term"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False)
    papers, place = np.unique(hits["paper_id"].to_numpy(), return_inverse=True)
    weights = np.zeros((len(known.dictionary), len(papers)))
    np.add.at(weights, (code[: len(place)], place), hits["w"].to_numpy())
    rows = leading.append_column("code", pa.array(code[len(place) :], pa.int32())).sort_by("query_id")
    query, term = rows["query_id"].to_numpy(), rows["code"].to_numpy()
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    asked, least = query[starts], rows["reach"].to_numpy()[starts]
    ends, found, at = np.r_[starts[1:], len(query)], [], 0
    while at < len(starts) and len(papers):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _AT_ONCE, "right")))
        sums = np.add.reduceat(weights[term[starts[at] : ends[to - 1]]], starts[at:to] - starts[at], axis=0)
        q, p = np.nonzero((sums > 0) & (sums >= least[at:to, None]))
        found.append((asked[at:to][q], papers[p], sums[q, p]))
        at = to
    q, p, score = (np.concatenate(c) for c in zip(*found)) if found else (query[:0], papers[:0], np.zeros(0))
    return pa.table({"query_id": pa.array(q, leading.schema.field("query_id").type), "paper_id": pa.array(p, pa.int64()), "score": score})


def search_best(index: LexicalIndex, queries: DataFrame, top: int, allowed: DataFrame | None = None) -> DataFrame:
    """The rows of search_index, exactly, from bounds on blocks of postings: papers that can't be among the best aren't weighed in full."""
    return best_of(_summed(pruned_weights(index, queries, top, allowed)[0]), top)
