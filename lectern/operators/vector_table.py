"""Quantised vectors as a stored table of blocks, by model, which searches read instead of the vectors themselves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.sources.artifacts import publish, published

_BLOCK = "code int, ids array<long>, q binary, scale array<float>, center binary, reach double"
_TOP = "paper_id long, score double, best double"
#: More than a bound can be off by rounding.
_SLACK = 1e-7


def _slug(model: str) -> str:
    return re.sub(r"[^A-Za-z0-9.-]", "_", model)


def write(embeddings: DataFrame, path: str, model: str, block: int = 1024, planes: int = 12) -> DataFrame:
    """A new version of a model's table from embeddings (paper_id, vector), and that model as the current one; returns its blocks.

    A vector's code is the side of `planes` planes on which it lies. Vectors are dealt and sorted by code, so that a block's are near
    each other; a block has the center of its vectors and the distance of the farthest from it. Null vectors are left out.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(1)
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
                x, scale = vectors.quantized(v)
                normals = np.random.default_rng(7).normal(size=(v.shape[1], planes))
                code = ((v @ normals) > 0) @ (1 << np.arange(planes))
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(scale, pa.float32())], ["code", "paper_id", "q", "scale"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                raw, scale = part.column("q").to_pylist(), part.column("scale").to_numpy()
                x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float64) * scale.astype(np.float64)[:, None]
                center = x.mean(axis=0)
                reach = float(np.linalg.norm(x - center, axis=1).max())
                values = ([part.column("code")[0].as_py()], [part.column("paper_id").to_pylist()], [b"".join(raw)], [scale.tolist()], [center.tobytes()], [reach])
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float32()), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    rows = embeddings.where("vector is not null").select("paper_id", "vector").mapInArrow(coded, "code int, paper_id long, q binary, scale float")
    dealt = rows.repartitionByRange("code", "paper_id").sortWithinPartitions("code", "paper_id").mapInArrow(packed, _BLOCK)
    out = publish(embeddings.sparkSession, f"{path}/models/{_slug(model)}", dealt)
    publish(embeddings.sparkSession, f"{path}/current", embeddings.sparkSession.createDataFrame([(model,)], "model string").coalesce(1))
    return out


def current(spark: SparkSession, path: str) -> tuple[str, DataFrame] | None:
    """(model, blocks) of the current model; None before the first."""
    found = published(spark, f"{path}/current")
    if found is None:
        return None
    model = found.first().model
    return model, published(spark, f"{path}/models/{_slug(model)}")


def rows(blocks: DataFrame) -> DataFrame:
    """(paper_id, q, scale) of blocks, as the scans of dense take them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["q"], np.int8)
                n = len(row["ids"])
                q = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(x) // n), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), q, pa.array(row["scale"], pa.float32())], ["paper_id", "q", "scale"])

    return blocks.select("ids", "q", "scale").mapInArrow(run, "paper_id long, q array<tinyint>, scale float")


def top(blocks: DataFrame, anchors: list[list[float]], k: int) -> DataFrame:
    """(paper_id, score, best, rank): the k papers with the best score as dense.anchor_scores has it, the smaller id first at equal ones.

    A task keeps its best k so far. Of a block, no score can be above that of its center by more than the anchors' length times the
    block's reach; a block that cannot come up to the task's k-th best is passed over, and its vectors aren't looked at.
    """
    q, q_scale = vectors.quantized(np.array(anchors, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = q.astype(np.float64) * q_scale.astype(np.float64)[:, None]
        length = np.linalg.norm(whole, axis=1)
        combined = lambda c: (c[0] + c[1:].max(axis=0)) / 2 if len(c) > 1 else c[0]
        held: tuple = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for batch in batches:
            for row in sorted(batch.to_pylist(), key=lambda r: -combined(whole @ np.frombuffer(r["center"]) + length * r["reach"])):
                bound = combined(whole @ np.frombuffer(row["center"]) + length * row["reach"])
                if len(held[0]) == k and bound < held[1][-1] - _SLACK:
                    continue
                ids = np.array(row["ids"], np.int64)
                x = np.frombuffer(row["q"], np.int8).reshape(len(ids), -1).astype(np.float64)
                cosine = (q.astype(np.float64) @ x.T) * np.array(row["scale"], np.float64) * q_scale.astype(np.float64)[:, None]  # whole numbers, exact
                found = tuple(map(np.concatenate, zip(held, (ids, combined(cosine), cosine.max(axis=0)))))
                order = np.lexsort((found[0], -np.round(found[1], 9)))[:k]
                held = tuple(c[order] for c in found)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], [c.split()[0] for c in _TOP.split(", ")])

    best = blocks.mapInArrow(run, _TOP).orderBy(F.desc(F.round("score", 9)), "paper_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "paper_id")))
