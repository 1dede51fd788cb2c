"""Exact scans over int8 vectors, one query or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import vectors


def quantize(embeddings: DataFrame) -> DataFrame:
    """(paper_id, q, scale) from (paper_id, vector)."""
    return embeddings.select("paper_id", vectors.int8_values(F.col("vector")).alias("q"), vectors.int8_scale(F.col("vector")).alias("scale"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cosines(batch: pa.RecordBatch, q: np.ndarray, q_scale: np.ndarray) -> np.ndarray:
    """Of each row to each anchor. Rows are (id, vector), quantised here, or (id, q, scale)."""
    if batch.num_columns == 2:
        x, scale = vectors.quantized(_matrix(batch.column(1)).astype(np.float32))
    else:
        x, scale = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
    return (x.astype(np.int32) @ q.T.astype(np.int32)) * scale.astype(np.float64)[:, None] * q_scale.astype(np.float64)


def scanned(embeddings: DataFrame) -> DataFrame:
    """What a scan reads: stored whole numbers if there are any, else vectors."""
    if "q" in embeddings.columns:
        return embeddings.where("q is not null").select("paper_id", "q", "scale")
    return embeddings.where("vector is not null").select("paper_id", "vector")


def scores(embeddings: DataFrame, anchors: list[list[float]]) -> DataFrame:
    """(paper_id, anchor, cosine) of every paper to each anchor, from whole-number dot products.

    embeddings are (paper_id, vector), or (paper_id, q, scale) as quantize gives them. Anchors are few and of the caller's
    making; they travel with the task. One Arrow pass, no shuffle.
    """
    q, q_scale = vectors.quantized(np.array(anchors, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine, ids = _cosines(batch, q, q_scale), batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(q))), pa.array(np.tile(np.arange(len(q), dtype=np.int32), len(ids))), pa.array(cosine.ravel())], ["paper_id", "anchor", "cosine"])

    return scanned(embeddings).mapInArrow(run, "paper_id long, anchor int, cosine double")


def anchor_scores(embeddings: DataFrame, anchors: list[list[float]], experience: list[float] | None = None) -> DataFrame:
    """(paper_id, score, best, e): multi_anchor of scores, and the cosine to the experience (null without), in one pass without a shuffle."""
    q, q_scale = vectors.quantized(np.array([*anchors, *([experience] if experience is not None else [])], np.float32))
    n = len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _cosines(batch, q, q_scale)
                score = (cosine[:, 0] + cosine[:, 1:n].max(axis=1)) / 2 if n > 1 else cosine[:, 0]
                own = pa.array(cosine[:, n]) if experience is not None else pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(cosine[:, :n].max(axis=1)), own], ["paper_id", "score", "best", "e"])

    return scanned(embeddings).mapInArrow(run, "paper_id long, score double, best double, e double")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, paper_id, cosine, rank): for each row of queries (query_id, vector) the k nearest papers, the smaller id
    first at equal cosines, the query's own paper included.

    Both sides are packed into blocks, and each pair of blocks gives k papers for each query at most, so what is ranked is
    small. The work is that of an exact search: queries times papers.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x, scale = vectors.quantized(_matrix(part.column(1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([scale.tolist()], pa.list_(pa.float32()))], ["ids", "x", "scale"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, own = np.array(row["ids"]), np.array(row["q_ids"])
                x, q = (np.frombuffer(row[c], np.int8).reshape(n, -1).astype(np.int32) for c, n in (("x", len(ids)), ("q", len(own))))
                cosine = np.round((q @ x.T) * np.array(row["q_scale"], np.float64)[:, None] * np.array(row["scale"], np.float64), 9)
                order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :k]
                at = np.arange(len(own))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, order.shape[1])), pa.array(ids[order].ravel()), pa.array(cosine[at, order].ravel())], ["query_id", "paper_id", "cosine"])

    shape = "ids array<long>, x binary, scale array<float>"
    papers = embeddings.where("vector is not null").select("paper_id", "vector").mapInArrow(packed, shape)
    asked = queries.where("vector is not null").select("query_id", "vector").mapInArrow(packed, shape).toDF("q_ids", "q", "q_scale")
    best = papers.crossJoin(asked).mapInArrow(met, "query_id long, paper_id long, cosine double")  # of blocks
    order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "paper_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multi_anchor(scored: DataFrame) -> DataFrame:
    """(paper_id, score, best): anchor 0 is the primary one, the others are topics.

    score is the mean of the primary cosine and the best topic's, or the primary alone without topics; best is the
    largest of all, which is what papers found by words alone are shown with.
    """
    found = scored.groupBy("paper_id").agg(F.max(F.when(F.col("anchor") == 0, F.col("cosine"))).alias("p"), F.max(F.when(F.col("anchor") > 0, F.col("cosine"))).alias("t"), F.max("cosine").alias("best"))
    return found.select("paper_id", F.when(F.col("t").isNull(), F.col("p")).otherwise((F.col("p") + F.col("t")) / 2).alias("score"), "best")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best with their rank, the smaller id first at equal scores: each task keeps k rows, and the driver merges those."""
    best = scored.orderBy(F.desc(F.round("score", 9)), "paper_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "paper_id")))


def restricted(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    return scored.join(allowed.select("paper_id"), "paper_id", "left_semi")


def anchor_vectors(embeddings: DataFrame, ids: list[int]) -> list[list[float]]:
    """The vectors of some papers, in the order of ids: as many rows as the caller names."""
    found = {r.paper_id: list(r.vector) for r in embeddings.where(F.col("paper_id").isin(ids)).collect()}
    return [found[i] for i in ids if i in found]
