"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER_AZ, components, grouped, in_small_batches, mix64, odd_constants, partitions_for, word_hashes, written

_MASK32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class MinHashConfig:
    """words: shingle length. threshold_percent: link at 100 * intersection >= threshold_percent * union.

    bands x rows registers are kept a document. A pair at the threshold shares no band with
    probability (1 - t**rows)**bands: 2e-6 for 0.85, 6 and 28.
    mantissa_bits: bits kept after the leading one of a bucket's smallest hash.
    slack_sigmas: a candidate is dropped only if its estimate lies that many standard errors below the threshold.
    """

    words: int = 5
    threshold_percent: int = 85
    bands: int = 28
    rows: int = 6
    mantissa_bits: int = 10
    slack_sigmas: float = 5.0
    #: Partners that are verified against one copy of a leader's text; a larger group is dealt to several tasks.
    partners_per_task: int = 64
    #: Members, and shingles of all members, in a block of a bucket whose members are in different components.
    block_members: int = 256
    block_shingles: int = 1 << 21

    @property
    def buckets(self) -> int:
        return self.bands * self.rows


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one hash of the whole sequence if there are fewer words."""
    w = word_hashes(text.translate(LOWER_AZ).split())
    if not len(w):
        return w
    c = odd_constants(words + 1, 11)
    if len(w) < words:
        return mix64(np.append(w * c[: len(w)], c[words:] * np.uint64(len(w))).sum(dtype=np.uint64, keepdims=True))
    n = len(w) - words + 1
    total = w[:n] * c[0]
    for k in range(1, words):
        total += w[k : k + n] * c[k]
    return np.unique(mix64(total))


def registers(sets: np.ndarray, k: int, mantissa_bits: int) -> np.ndarray:
    """HyperMinHash of a sorted distinct set: for each of k buckets, leading zeros and mantissa of its smallest hash; 0 if empty."""
    out = np.zeros(k, np.uint16)
    if not len(sets):
        return out
    kk = np.uint64(k)
    bucket = ((sets >> np.uint64(32)) * kk + ((sets & _MASK32) * kk >> np.uint64(32))) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = sets[first] * kk  # the place inside the bucket, as a fraction of 2**64
    top = rest >> np.uint64(11)
    zeros = np.minimum(53 - np.frexp(top.astype(np.float64))[1], 52).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa_bits)
    out[bucket[first].astype(np.int64)] = ((zeros << np.uint64(mantissa_bits)) | mantissa).astype(np.uint16) + 1
    return out


def _probes(k: int) -> np.ndarray:
    """For each bucket, the order in which it looks for another one's register when it is empty."""
    return (mix64(np.arange(k * 64, dtype=np.uint64) + np.uint64(77)) % np.uint64(k)).astype(np.int64).reshape(k, 64)


def densified(raw: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Empty registers borrow from a full bucket that a fixed random order names, so equal sets of any size agree."""
    empty = np.flatnonzero(raw == 0)
    if not len(empty) or len(empty) == len(raw):
        return raw
    out, full = raw.copy(), raw != 0
    tries = full[probes[empty]]
    hit = tries.any(axis=1)
    found = empty[hit]
    out[found] = raw[probes[found, tries[hit].argmax(axis=1)]]
    if not hit.all():
        at = np.flatnonzero(full)
        late = empty[~hit]
        out[late] = raw[at[np.searchsorted(at, late) % len(at)]]
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray, k: int, mantissa_bits: int) -> np.ndarray:
    """Probability that a register of two disjoint sets of n and m members agrees by chance.

    Over the octave (2**-(i+1), 2**-i) all cells are 2**-(i+1+mantissa_bits) wide; the smallest of a
    bucket's n/k members has the density a*exp(-a*x).
    """
    a, b = np.maximum(n, 1) / k, np.maximum(m, 1) / k
    both, total = a * b / (a + b), np.zeros(len(a))
    for i in range(53):
        lo, hi = 2.0 ** -(i + 1), 2.0**-i
        total += 2.0 ** -(i + 1 + mantissa_bits) * both * (np.exp(-(a + b) * lo) - np.exp(-(a + b) * hi))
    return total


def estimated_jaccard(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa_bits: int) -> np.ndarray:
    """Collision-corrected estimates for rows of raw registers: (matches - expected chance matches) / buckets in use."""
    used = ((x != 0) | (y != 0)).sum(axis=1)
    both = ((x != 0) & (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    chance = both * expected_collisions(n, m, x.shape[1], mantissa_bits)
    return np.clip((same - chance) / np.maximum(used, 1), 0.0, 1.0)


def sketches(docs: DataFrame, cfg: MinHashConfig, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: id, the text's hash, n_shingles, the set's 128-bit fingerprint and its registers. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, regs = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingles(text or b"", cfg.words)
                n.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                f1.append(int.from_bytes(d[:8], "little", signed=True))
                f2.append(int.from_bytes(d[8:], "little", signed=True))
                regs.append(registers(s, cfg.buckets, cfg.mantissa_bits).tobytes() if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "h", "n", "f1", "f2", "regs"])

    return _texts(in_small_batches(docs), id_col, text_col).mapInArrow(run, "doc long, h long, n long, f1 long, f2 long, regs binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def band_keys(raw: list[bytes], cfg: MinHashConfig) -> np.ndarray:
    """A row of keys, one for each band, for each of the registers given."""
    probes, consts = _probes(cfg.buckets), odd_constants(cfg.rows + 1, 5)
    full = np.stack([densified(np.frombuffer(r, np.uint16), probes) for r in raw])
    parts = full.reshape(len(full), cfg.bands, cfg.rows).astype(np.uint64) + np.uint64(1)
    mixed = mix64((mix64(parts * consts[: cfg.rows]) * consts[: cfg.rows]).sum(axis=2, dtype=np.uint64))
    return mix64(mixed + np.arange(cfg.bands, dtype=np.uint64) * consts[cfg.rows]).view(np.int64)


def _bands(nodes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(key, node): one row for each band of a node's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(batch.column(1).to_pylist(), cfg)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), cfg.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids, pa.int64())], ["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def _across(placed: DataFrame, nodes: DataFrame, cfg: MinHashConfig) -> DataFrame | None:
    """(key, block, salt, a, b, of_a, of_b): candidates across components in one bucket, and their components, packed; None
    if no bucket is mixed.

    Of two members in different components one at least is outside the bucket's largest component. So only those
    outside are copied, once for each block of the bucket's members, and every member once for each block of those
    outside: a bucket of m members with k outside has about m rows for each block_members of k. A pair is taken in the
    first band that it shares, if its sizes allow a link and its estimate does not rule it out.
    """
    sized = placed.join(nodes.select("node", "n"), "node")
    per = sized.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("members", "shingles", "component"))
    mixed = per.groupBy("key").agg(top.alias("top"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("components")).where("components > 1")
    pieces = lambda members, shingles: F.greatest(F.ceil(members / cfg.block_members), F.ceil(shingles / cfg.block_shingles)).cast("int")
    members, shingles = F.col("members"), F.col("shingles")
    blocks = pieces(members - F.col("top.members"), shingles - F.col("top.shingles")).alias("blocks")
    mixed = written(mixed.select("key", F.col("top.component").alias("main"), members, (members - F.col("top.members")).alias("outside"), blocks, pieces(members, shingles).alias("salts")), "mixed_buckets")
    total = mixed.agg(F.sum(F.col("members") * F.col("blocks") + F.col("outside") * F.col("salts"))).first()[0]
    if not total:
        return None
    every = placed.join(mixed.drop("members", "outside"), "key").withColumn("outside", F.col("component") != F.col("main"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    order = ["key", "block", "salt", "met", "outside", "node", "component"]
    held = every.where("outside").withColumn("block", own(0, F.col("blocks"))).withColumn("salt", spread(F.col("salts"))).withColumn("met", F.lit(False))
    met = every.withColumn("salt", own(1, F.col("salts"))).withColumn("block", spread(F.col("blocks"))).withColumn("met", F.lit(True))
    rows = held.select(*order).unionByName(met.select(*order)).join(nodes.select("node", "n", "regs"), "node").select(*order, "n", "regs")
    parts = partitions_for(placed.sparkSession, total, 4_000, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, pairs, rows = [], [], 0
        for group, found in grouped(batches, 3):
            block = pa.Table.from_batches(found).combine_chunks()
            met, outside, node, component, n = (block.column(c).to_numpy() for c in ("met", "outside", "node", "component", "n"))
            left, right, taken = np.flatnonzero(~met), np.flatnonzero(met), []
            for i in left:
                small, large = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
                taken.append(right[(component[right] != component[i]) & (small * 100 >= large * cfg.threshold_percent) & (~outside[right] | (node[right] > node[i]))])
            if taken and sum(map(len, taken)):
                pairs.append((np.repeat(left, [len(t) for t in taken]) + rows, np.concatenate(taken) + rows))
                groups.append((group, block, len(pairs[-1][0])))
                rows += len(node)
            if rows >= 4096:
                yield from _packed(groups, pairs, cfg)
                groups, pairs, rows = [], [], 0
        yield from _packed(groups, pairs, cfg)

    dealt = rows.repartition(parts, "key", "block", "salt").sortWithinPartitions("key", "block", "salt")
    return dealt.mapInArrow(run, "key long, block int, salt int, a array<long>, b array<long>, of_a array<long>, of_b array<long>")


def _packed(groups: list[tuple], pairs: list[tuple[np.ndarray, np.ndarray]], cfg: MinHashConfig) -> Iterator[pa.RecordBatch]:
    """A row for each group of a bucket with the pairs (places among all groups' rows) that may be links and share no earlier band."""
    if not groups:
        return
    every = pa.concat_tables([block for _, block, _ in groups])
    node, component, n, raw = *(every.column(c).to_numpy() for c in ("node", "component", "n")), every.column("regs").to_pylist()
    keys, regs = band_keys(raw, cfg), np.frombuffer(b"".join(raw), np.uint16).reshape(-1, cfg.buckets)
    group = np.repeat(np.arange(len(groups)), [count for *_, count in groups])
    wanted, t = np.array([key for (key, _, _), *_ in groups])[group], cfg.threshold_percent / 100
    left, right, keep = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]), []
    for k in range(0, len(left), 8192):
        i, j = left[k : k + 8192], right[k : k + 8192]
        same = keys[i] == keys[j]
        good = np.flatnonzero(keys[i, same.argmax(axis=1)] == wanted[k : k + 8192])
        i, j = i[good], j[good]
        wide = np.sqrt(t * (1 - t) / np.maximum(1, np.minimum(cfg.buckets, np.minimum(n[i], n[j]))))
        keep.append(k + good[estimated_jaccard(regs[i], regs[j], n[i], n[j], cfg.mantissa_bits) >= t - cfg.slack_sigmas * wide])
    kept = np.concatenate(keep)
    for k in np.unique(group[kept]):
        own, (key, block, salt) = kept[group[kept] == k], groups[k][0]
        lists = [pa.array([values[x[own]]], pa.list_(pa.int64())) for values in (node, component) for x in (left, right)]
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block], pa.int32()), pa.array([salt], pa.int32()), *lists], ["key", "block", "salt", "a", "b", "of_a", "of_b"])


def _verified_blocks(packed: DataFrame, texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs (a, b) of _across that hold on full shingle sets, as many as it takes to join the components that they join.

    A task holds the sets of one pair of blocks. A pair whose components are joined already is passed over, so that a group
    gives fewer links than it has components.
    """
    keys, lists = ["key", "block", "salt"], ["a", "b", "of_a", "of_b"]
    wanted = packed.select(*keys, F.explode(F.array_distinct(F.concat("a", "b"))).alias("doc")).join(texts, "doc")
    rows = packed.select(*keys, F.lit(None).cast("long").alias("doc"), F.lit(None).cast("string").alias("text"), *lists).unionByName(wanted, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches, 3):
            sets, pairs, joined, a, b = {}, [], {}, [], []
            for part in parts:
                for doc, text, *columns in zip(part.column("doc").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c) for c in lists)):
                    if doc is None:
                        pairs = list(zip(*(c.as_py() for c in columns)))
                    else:
                        sets[doc] = shingles(text or b"", cfg.words)

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    joined[c] = c = joined.get(up, up)
                return c

            for x, y, of_x, of_y in pairs:
                if (p := root(of_x)) != (q := root(of_y)) and _linked(sets[x], sets[y], cfg):
                    joined[p] = q
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, cfg: MinHashConfig) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    meet = int((both[1:] == both[:-1]).sum())
    return meet > 0 and 100 * meet >= cfg.threshold_percent * (len(both) - meet)


def _likely(pairs: DataFrame, nodes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimate does not rule it out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    t = cfg.threshold_percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, cfg.buckets) for c in ("regs_a", "regs_b"))
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            wide = np.sqrt(t * (1 - t) / np.maximum(1, np.minimum(cfg.buckets, np.minimum(n, m))))
            keep = estimated_jaccard(x, y, n, m, cfg.mantissa_bits) >= t - cfg.slack_sigmas * wide
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    ratio = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * cfg.threshold_percent) | (F.col("n_a") == F.col("n_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").where(ratio)
    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The pairs (a, b) that hold on full shingle sets. texts: (doc, text).

    A leader a travels once for every partners_per_task partners, so a group of any size is spread
    over tasks and no task holds more than one leader's sets and one partner's.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / cfg.partners_per_task).cast("int").alias("salts")), "a")
    partner = sized.select(F.col("b").alias("doc"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("leads"))
    leader = pairs.groupBy("a").agg(F.ceil(F.count("*") / cfg.partners_per_task).cast("int").alias("salts"))
    leader = leader.select(F.col("a").alias("doc"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("leads"))
    rows = partner.unionByName(leader).join(texts, "doc").select("lead", "salt", "leads", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            a, b = [], []
            lead, salt, leads, doc, text = (batch.column(k) for k in range(5))
            lead, salt, leads, doc = (c.to_pylist() for c in (lead, salt, leads, doc))
            for k, raw in enumerate(text.cast(pa.binary())):
                own = shingles(raw.as_py() or b"", cfg.words)
                if (lead[k], salt[k]) != now:
                    now, held = (lead[k], salt[k]), []
                if leads[k]:
                    held.append(own)
                    continue
                if any(_linked(s, own, cfg) for s in held):
                    a.append(lead[k])
                    b.append(doc[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("leads")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    1. One pass makes each document's registers and a fingerprint of its shingle set; equal sets become one node.
    2. Bands of registers are grouped by partial aggregation. Each node is first held against the smallest node of
       a bucket only (the one with which it shares most bands), so a group of many near copies costs one
       verification a member. Links found are closed into components.
    3. In buckets whose members are still in different components, those outside the largest one are held against all,
       block by block.
    4. All candidates pass the size bound and the collision-corrected estimate, then the check on full sets.
       Pairs inside one component need no check: they cannot change the result.

    Defined cases: null or empty text and text without words have n_shingles 0 and link with nothing; a row with
    null id links with nothing, has component_id null and is kept; repeated rows each come back; an id with several
    texts has a row for each, and all of them are compared; of a node's equally good leaders the smallest is taken; other
    columns are ignored; an empty table gives no rows.
    """
    drawn = written(sketches(docs, cfg, id_col, text_col), "sketches")
    some = drawn.where((F.col("n") > 0) & F.col("doc").isNotNull())
    # a node is a distinct set; its number is stored with the smallest id that has the set, and the hash of that one's text.
    # Numbers go up with ids: the first of a group of copies is likely to be what the others were copied from
    sets = some.groupBy("f1", "f2").agg(F.min(F.struct("doc", "h")).alias("own")).select("f1", "f2", "own.doc", "own.h")
    sets = sets.repartitionByRange("doc", "f1").sortWithinPartitions("doc", "f1")
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = written(some.join(sets, ["f1", "f2", "doc", "h"]).select("node", "n", "regs").dropDuplicates(["node"]), "nodes")
    bands = _bands(nodes, cfg)
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1").select("key", "leader")
    shared = written(bands.join(leaders, "key"), "shared_bands", records=20_000)

    votes = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader")).alias("first"))).alias("m"))
    first = written(_likely(best.select((-F.col("m.first")).alias("a"), F.col("node").alias("b")), nodes, cfg), "pairs")
    wanted = sets.join(shared.select("node").distinct(), "node").select("doc", "h", "node")
    texts = _texts(docs, id_col, text_col).join(wanted, ["doc", "h"]).dropDuplicates(["doc", "h"])
    texts = written(texts.select(F.col("node").alias("doc"), "text"), "texts")
    links = written(_verified(first, texts, cfg), "links")

    near = components(links, "a", "b")
    placed = written(shared.join(near, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed_bands")
    second = _across(placed, nodes, cfg)
    if second is not None and not (second := written(second, "packed_pairs")).isEmpty():
        added = written(_verified_blocks(second, texts, cfg), "links")
        near = components(links.unionByName(added), "a", "b") if not added.isEmpty() else near

    ids = near.join(sets.select("node", "doc"), "node")
    firsts = ids.join(ids.groupBy("component").agg(F.min("doc").alias("first")), "component").select("node", "first")
    named = drawn.select("doc", "n", "f1", "f2").join(sets.select("f1", "f2", "node", F.col("doc").alias("own")), ["f1", "f2"], "left").join(firsts, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("first", "own", "doc"))
    return named.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))
