"""A Merkle manifest of a dataset: rows ranked within groups by digits of their keys, nodes named by digits of ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import written
from lectern.operators.ranking import ranks


@dataclass(frozen=True)
class MerkleConfig:
    """fanout: children of a node. levels: of the tree that one step reduces, so that it gathers fanout ** levels nodes.

    digits: hexadecimal ones by which a bucket of keys is parted. bucket: rows that are ranked together.
    """

    fanout: int = 2
    levels: int = 10
    digits: int = 3
    bucket: int = 4096


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of each value its length in bytes, a colon and itself; of null a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def sort_key(doc_id: Column, digest: Column, row: Column) -> Column:
    """Hexadecimal digits that ascend with the id, null first, then with the digest and the row's number."""
    digits = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")  # noqa: E731  the sign turned, so that unsigned order is the numbers'
    return F.concat(F.when(doc_id.isNull(), F.repeat(F.lit(" "), F.lit(16))).otherwise(digits(doc_id)), digest, digits(row))


def ranked(rows: DataFrame, cfg: MerkleConfig) -> DataFrame:
    """rows (g, key, ...) with r, their rank from 0 within g by key; keys are distinct, of one length.

    A histogram of the keys' first digits, summed up within g, says how many rows come before each bucket. A bucket with more
    than cfg.bucket rows is parted by its next digits, and so on; in small ones a row's place is counted. So no group, nor a
    run of keys that share their digits, is sorted in one task, and an even spread takes one round.
    """
    ends = rows.where(~F.col("key").startswith(" ")).agg(F.min("key"), F.max("key")).first()
    common = next((k for k, (a, b) in enumerate(zip(*ends)) if a != b), 0) if ends[0] is not None else 0
    above = rows.select("g").distinct().select("g", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    open_, length, last, parts = rows, common + cfg.digits, 0, []
    while True:
        prefix = F.substring("key", 1, length)
        counted = open_.groupBy("g", prefix.alias("prefix")).agg(F.count("*").alias("n")).withColumn("parent", F.substring("prefix", 1, last))
        within = W.partitionBy("g", "parent").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)  # 16 ** digits at most
        summed = counted.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        bases = above.select("g", F.col("prefix").alias("parent"), "base")
        histogram = written(summed.join(bases, ["g", "parent"]).select("g", "prefix", "n", (F.col("base") + F.col("before")).alias("base")), "histogram")
        dealt = written(open_.withColumn("prefix", prefix).join(histogram, ["g", "prefix"]), "bucketed")  # stored, so that the join can be split
        place = F.row_number().over(W.partitionBy("g", "prefix").orderBy("key")) - 1
        parts.append(dealt.where(F.col("n") <= cfg.bucket).withColumn("r", F.col("base") + place).select(*rows.columns, "r"))
        large = F.col("n") > cfg.bucket
        above = histogram.where(large)
        if above.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        open_, last, length = dealt.where(large).select(*rows.columns), length, length + cfg.digits


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def subtree(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The levels of a tree over consecutive nodes, the nodes first, its root alone last."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest(low[k : k + fanout]) for k in range(0, len(low), fanout)])
    return out


def path(tree: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """For each level, the digests before and behind node `at` within its run."""
    out = []
    for low in tree[:-1]:
        first = at - at % fanout
        out.append(("".join(low[first:at]), "".join(low[at + 1 : first + fanout])))
        at //= fanout
    return out


_STEP = "g string, r long, up long, before array<string>, behind array<string>, digest string, done int, height int, node string, doc_id long, tampered string"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())


def _step(nodes: DataFrame, cfg: MerkleConfig) -> DataFrame:
    """Nodes (g, r, digest, done, height) whose ranks share all but their last digits, cfg.levels of them, are reduced to one.

    Returns each node with its path within its subtree, the subtree's rank (up) and, with its first node, its digest. done:
    levels reduced so far; height: of the group's tree. doc_id and tampered, of leaves, go along.
    """
    fanout = cfg.fanout
    levels = F.least(F.lit(cfg.levels), F.col("height") - F.col("done"))
    width = F.pow(F.lit(fanout), levels).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, others, rows = None, [], [], []

        def reduced() -> None:
            g, up, levels, done, height = now
            tree = subtree(held, fanout, levels)
            for k, (steps, more) in enumerate(zip((path(tree, k, fanout) for k in range(len(held))), others)):
                rows.append((g, up * fanout**levels + k, up, [b for b, _ in steps], [a for _, a in steps], None if k else tree[-1][0], done + levels, height, held[k], *more))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _STEP.split(", ")])

        for batch in batches:
            for *key, node, doc, changed in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if held:
                        reduced()
                    if len(rows) >= 2048:
                        yield batch_of()
                        rows.clear()
                    now, held, others = key, [], []
                held.append(node)
                others.append((doc, changed))
        if held:
            reduced()
        if rows:
            yield batch_of()

    dealt = nodes.withColumn("levels", levels).withColumn("up", F.call_function("div", F.col("r"), width))
    dealt = dealt.repartition("g", "up").sortWithinPartitions("g", "up", "r")
    return dealt.select("g", "up", "levels", "done", "height", "digest", "doc_id", "tampered").mapInArrow(run, _STEP)


def reduced(leaves: DataFrame, cfg: MerkleConfig) -> tuple[DataFrame, DataFrame]:
    """((g, root), leaves): the roots of the groups' trees over leaves (g, r, digest, doc_id, tampered), and the leaves, each as
    node with its path (before, behind).

    A step reduces subtrees of up to fanout ** levels nodes that share the longest prefix of their ranks' digits, so there is
    one for each `levels` levels; then paths are joined from the root down, subtree by subtree.
    """
    sizes = leaves.groupBy("g").agg(F.count("*").alias("n"))
    powers = [cfg.fanout**k for k in range(63) if cfg.fanout**k < 1 << 63]
    height = reduce(Column.__add__, (F.when(F.col("n") > F.lit(p), 1).otherwise(0) for p in powers))
    nodes = leaves.join(sizes.select("g", height.cast("int").alias("height")), "g").select("g", "r", "digest", F.lit(0).alias("done"), "height", "doc_id", "tampered")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("tampered", "string"))]
    steps, roots = [], []
    while True:
        step = written(_step(nodes, cfg), "merkle_step")
        steps.append(step)
        up = step.where("digest is not null")
        roots.append(up.where("done = height").select("g", F.col("digest").alias("root")))
        nodes = up.where("done < height").select("g", F.col("up").alias("r"), "digest", "done", "height", *none)
        if nodes.isEmpty():
            break
    kept, empty = ("g", "r", "node", "doc_id", "tampered"), F.array().cast("array<string>")
    paths = steps[-1].select(*kept, "before", "behind")
    for step in reversed(steps[:-1]):
        above = paths.select("g", F.col("r").alias("up"), F.col("before").alias("b"), F.col("behind").alias("a"))
        both = [F.concat(own, F.coalesce(more, empty)).alias(own) for own, more in (("before", "b"), ("behind", "a"))]
        paths = step.join(above, ["g", "up"], "left").select(*kept, *both)
    return reduce(DataFrame.unionByName, roots), paths


def folded(node: Column, before: Column, behind: Column) -> Column:
    """The root that a node and the digests beside its path give."""
    return F.aggregate(F.arrays_zip(before.alias("b"), behind.alias("a")), node, lambda h, x: F.sha2(F.concat(x["b"], h, x["a"]), 256))


def manifest(docs: DataFrame, cfg: MerkleConfig = MerkleConfig(), tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs (doc_id, source, lang, n_chars, text).

    Leaves of a language form a tree in the order of their ids, the languages' roots, null first, another one above. proof_sha256
    is the digest of all digests beside the row's path; folded_root follows from it and the row's leaf. tampered: a leaf that
    takes its place there, null where the row's own does. Texts are read once and digested where they are read; what moves is
    digests.

    Defined cases: a null value differs from an empty one; a null id comes before all others; rows with one id are in the order
    of their leaves, and repeated rows are leaves of their own; a null language is a group of its own, before the empty one;
    other columns are ignored; an empty table gives no rows.
    """
    columns = [F.col(c).cast(t) for c, t in zip(LEAF_COLUMNS, ("long", "string", "string", "long", "string"))]
    g = F.coalesce(F.concat(F.lit("="), columns[2]), F.lit(""))
    rows = docs.select(columns[0].alias("doc_id"), g.alias("g"), leaf(columns).alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    stored = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    keyed = stored.select("g", sort_key(F.col("doc_id"), F.col("leaf"), F.col("row")).alias("key"), "doc_id", "leaf", "tampered")
    leaves = ranked(keyed, cfg).select("g", "r", F.col("leaf").alias("digest"), "doc_id", "tampered")
    subroots, paths = reduced(written(leaves, "ranked_leaves"), cfg)
    tops = written(ranks(subroots, [], ["g"]).select("g", (F.col("rank") - 1).cast("long").alias("r"), "root"), "subroots")
    roots, upper = reduced(tops.select(F.lit("").alias("g"), "r", F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")), cfg)
    above = tops.join(upper.select("r", F.col("before").alias("b"), F.col("behind").alias("a")), "r").select("g", F.col("root").alias("subroot"), "b", "a")
    whole = paths.join(above, "g").join(F.broadcast(roots.select("root"))).withColumnRenamed("node", "leaf")  # one root
    before, behind = F.concat("before", "b"), F.concat("behind", "a")
    proof = F.sha2(F.array_join(F.transform(F.arrays_zip(before.alias("b"), behind.alias("a")), lambda x: F.concat(x["b"], x["a"])), ""), 256)
    found = whole.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), before, behind).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
