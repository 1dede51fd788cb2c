"""Scans for many searches at once: blocks of searches, each with its anchors and gate, against blocks of papers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import vectors

#: What an anchor of a search is: the primary one, a topic, the user's experience.
PRIMARY, TOPIC, EXPERIENCE = 0, 1, 2
_FOUND = "query_id long, paper_id long, score double, best double, e double"
_EARLIEST = -(1 << 63)


def _joined(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], [c.split()[0] for c in _FOUND.split(", ")])


def _search_scores(cosine: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, best, e) of papers (columns) from the cosines of one search's anchors (rows), as dense.anchor_scores has them."""
    own, topics = cosine[kinds == PRIMARY][0], cosine[kinds == TOPIC]
    score = (own + topics.max(axis=0)) / 2 if len(topics) else own
    best = np.maximum(own, topics.max(axis=0)) if len(topics) else own
    known = cosine[kinds == EXPERIENCE]
    return score, best, known[0] if len(known) else np.full(cosine.shape[1], np.nan)


def _quantised(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    if "q" in part.schema.names:
        q = part.column("q")
        return q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1).astype(np.int8), part.column("scale").to_numpy(zero_copy_only=False)
    v = part.column("vector")
    return vectors.quantized(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float32))


def packed_papers(papers: DataFrame, block: int) -> DataFrame:
    """Blocks of papers (paper_id, vector or q and scale, published_us, coded, categories) for top_many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x, scale = _quantised(part)
                lists = [pa.array([part.column(c).to_pylist()], t) for c, t in (("paper_id", pa.list_(pa.int64())), ("published_us", pa.list_(pa.int64())), ("coded", pa.list_(pa.bool_())), ("categories", pa.list_(pa.list_(pa.string()))))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary()), pa.array([scale.tolist()], pa.list_(pa.float32()))], ["ids", "published", "coded", "categories", "x", "scale"])

    return papers.mapInArrow(run, "ids array<long>, published array<long>, coded array<boolean>, categories array<array<string>>, x binary, scale array<float>")


def packed_searches(searches: DataFrame, block: int) -> DataFrame:
    """Blocks of searches (query_id, kinds, anchors, since_us, no_code, wanted)."""
    number = F.floor((F.row_number().over(W.partitionBy("_s").orderBy("query_id")) - 1) / block)
    dealt = searches.withColumn("_s", F.pmod(F.xxhash64("query_id"), F.lit(64))).withColumn("_b", number)
    one = F.struct("query_id", "kinds", "anchors", "since_us", "no_code", "wanted")
    return dealt.groupBy("_s", "_b").agg(F.collect_list(one).alias("searches")).select("searches")


def _gate(search: dict, block: dict, by_category: dict[str, np.ndarray]) -> np.ndarray:
    keep = block["published"] >= (_EARLIEST if search["since_us"] is None else search["since_us"])
    if search["no_code"]:
        keep &= ~block["coded"]
    if search["wanted"]:
        of = np.zeros(len(keep), bool)
        for c in search["wanted"]:
            of[by_category.get(c, [])] = True
        keep &= of
    return keep


def top_many(papers: DataFrame, searches: DataFrame, size: int, block: int = 2048, search_block: int = 64) -> DataFrame:
    """(query_id, paper_id, score, best, e, rank): the `size` best papers of each search that its gate lets through.

    papers (paper_id, vector or q and scale, published_us, coded, categories); searches (query_id, kinds, anchors, since_us,
    no_code, wanted): of each anchor its kind and vector, and the gate: published at since_us or later, without code, in a wanted
    category, nulls and empty lists asking for nothing. A block of searches meets a block of papers in one product of
    matrices; a task keeps the best of each search over all blocks that it meets, so `size` rows a task and search are ranked.
    The work is that of an exact search.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, scale = np.array(row["ids"], np.int64), np.array(row["scale"], np.float64)
                x = np.frombuffer(row["x"], np.int8).reshape(len(ids), -1).astype(np.float64)
                block = {"published": np.array([_EARLIEST if p is None else p for p in row["published"]], np.int64), "coded": np.array(row["coded"], bool)}
                by_category: dict[str, list] = {}
                for k, own in enumerate(row["categories"]):
                    for c in own or ():
                        by_category.setdefault(c, []).append(k)
                for search in row["searches"]:
                    q, q_scale = vectors.quantized(np.array(search["anchors"], np.float32))
                    keep = np.flatnonzero(_gate(search, block, by_category))
                    if not len(keep):
                        continue
                    cosine = (q.astype(np.float64) @ x[keep].T) * scale[keep] * q_scale.astype(np.float64)[:, None]  # whole numbers, exact
                    found = (ids[keep], *_search_scores(cosine, np.array(search["kinds"])))
                    if (old := best.get(search["query_id"])) is not None:
                        found = tuple(map(np.concatenate, zip(old, found)))
                    order = np.lexsort((found[0], -np.round(found[1], 9)))[:size]
                    best[search["query_id"]] = tuple(c[order] for c in found)
        rows = [(np.full(len(c[0]), query), *c) for query, c in best.items()]
        for k in range(0, len(rows), 64):
            yield _joined(rows[k : k + 64])

    met_blocks = packed_papers(papers, block).crossJoin(packed_searches(searches, search_block)).mapInArrow(met, _FOUND)  # of blocks
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "paper_id")
    ranked = met_blocks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.withColumn("e", F.when(~F.isnan("e"), F.col("e")))


def pair_scores(pairs: DataFrame, embeddings: DataFrame, searches: DataFrame) -> DataFrame:
    """(query_id, paper_id, score, best, e) of given pairs whose paper has a vector."""
    scanned = [c for c in ("q", "scale", "vector") if c in embeddings.columns and not (c == "vector" and "q" in embeddings.columns)]
    rows = pairs.select("query_id", "paper_id").join(embeddings.where(F.col(scanned[0]).isNotNull()).select("paper_id", *scanned), "paper_id")
    rows = rows.join(searches.select("query_id", "kinds", "anchors"), "query_id").select("query_id", "paper_id", "kinds", "anchors", *scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, scale = _quantised(batch)
            kinds, anchors = batch.column("kinds").to_pylist(), batch.column("anchors").to_pylist()
            found = []
            for k in range(batch.num_rows):
                q, q_scale = vectors.quantized(np.array(anchors[k], np.float32))
                cosine = (q.astype(np.int64) @ x[k].astype(np.int64))[:, None] * scale[k].astype(np.float64) * q_scale.astype(np.float64)[:, None]
                found.append([float(c[0]) for c in _search_scores(cosine, np.array(kinds[k]))])
            score, best, e = map(np.array, zip(*found))
            yield _joined([(batch.column("query_id").to_numpy(), batch.column("paper_id").to_numpy(), score, best, e)])

    return rows.mapInArrow(run, _FOUND).withColumn("e", F.when(~F.isnan("e"), F.col("e")))
