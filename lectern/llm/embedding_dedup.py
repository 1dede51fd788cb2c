"""Vectors within a cosine threshold of each other, by dual traversal of cover trees over blocks of vectors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import components, grouped, in_small_batches, partitions_for, written

#: More than bounds can be off: a distance from a cosine near 1 has an error of 1.5e-8. Nodes within it of the threshold are
#: parted until cosines decide.
_SLACK = 1e-6
#: More than a single-precision product of unit vectors can be off.
_SCREEN = 1e-4


@dataclass(frozen=True)
class EmbeddingConfig:
    """threshold: link at a cosine of this or more. block: vectors of a block, so of one tree.

    A cell of more than two blocks is parted again, by at most `pivots` pivots from a sample of about `sample` of its
    vectors, `depth` times at most. top and finest: largest and smallest radius of a tree's levels below its root.
    held_bytes: of the trees that a task holds while it meets others.
    """

    threshold: float = 0.9
    block: int = 4096
    sample: int = 2048
    pivots: int = 256
    depth: int = 8
    top: float = 0.5
    finest: float = 0.0625
    held_bytes: int = 64 << 20

    @property
    def reach(self) -> float:
        """Distance of two unit vectors at the threshold."""
        return float(np.sqrt(2 - 2 * self.threshold))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, values) of a column of lists; missing components become NaN, and a null list has length 0."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return lengths, np.concatenate(([0], np.cumsum(lengths)))[:-1], values


def units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors in double precision) of a column's usable vectors, by dimension."""
    lengths, starts, values = matrix(column)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        v = values[starts[rows][:, None] + np.arange(dim)]
        largest = np.abs(v).max(axis=1, keepdims=True)
        good = np.isfinite(v).all(axis=1) & (largest[:, 0] > 0)
        rows, v = rows[good], v[good] / largest[good]
        yield dim, rows, v / np.linalg.norm(v, axis=1, keepdims=True)


def _apart(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


@dataclass
class CoverTree:
    """Nested nodes: center (a point), radius (to its farthest descendant), the range of its points, and its children.

    Node 0 is the root, over all points. Points are in such an order that a node's descendants are adjoining. Below the
    root, levels halve the radius; a node of one point has radius 0 and no children.
    """

    x: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    center: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, cfg: EmbeddingConfig) -> CoverTree:
        single, radii, order = x.astype(np.float32), [], []
        r = cfg.top
        while r >= cfg.finest:
            radii.append(r)
            r /= 2
        tree = cls(x, ids, weights)

        def parted(members: np.ndarray, radius: float) -> list[np.ndarray]:
            """A greedy net: each part holds the first member that no part holds, and what lies within the radius of it."""
            groups, bound, left, y = [], np.float32(1 - radius * radius / 2), members, single[members]
            while len(left):
                near, free = y @ y[:64].T >= bound, np.ones(len(left), bool)
                for k in range(near.shape[1]):
                    if free[k]:
                        own = near[:, k] & free
                        own[k] = True
                        free &= ~own
                        own[k] = False
                        groups.append(np.concatenate((left[k : k + 1], left[own])))
                left, y = left[free], y[free]
            return groups

        def add(members: np.ndarray, level: int) -> int:
            node, c = len(tree.center), int(members[0])
            tree.center.append(c)
            tree.radius.append(0.0 if len(members) == 1 else float(np.linalg.norm(x[members] - x[c], axis=1).max()))
            tree.lo.append(len(order))
            tree.hi.append(len(order) + len(members))
            tree.children.append([])
            if len(members) == 1:
                order.append(c)
                return node
            while level < len(radii) and len(groups := parted(members, radii[level])) == 1:
                level += 1
            parts = groups if level < len(radii) else [members[k : k + 1] for k in range(len(members))]
            tree.children[node] = [add(p, level + 1) for p in parts]
            return node

        add(np.arange(len(x)), 0)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        tree.x, tree.ids, tree.weights, tree.center = x[order], ids[order], weights[order], place[tree.center].tolist()
        return tree

    def packed(self) -> bytes:
        counts = np.array([len(c) for c in self.children])
        flat = np.array([n for c in self.children for n in c], np.int64)
        return pickle.dumps((self.x, self.ids, self.weights, np.array(self.center), np.array(self.radius), np.array(self.lo), np.array(self.hi), counts, flat), protocol=5)


class _Nodes:
    """A tree as read back, with its children in arrays. tops: the children of the root, or the root if it has none."""

    def __init__(self, raw: bytes):
        self.x, self.ids, self.weights, self.center, self.radius, self.lo, self.hi, self.count, self.flat = pickle.loads(raw)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.tops = self.flat[: self.count[0]] if self.count[0] else np.zeros(1, np.int64)


class DualTraversal:
    """Links between the points of two trees, or within one: how many each point has (by weight), and which are connected by them.

    A pair of nodes is dropped if even their nearest descendants are too far apart, and taken whole if even the farthest
    are near enough; otherwise the wider node is parted into its children.
    """

    def __init__(self, a: _Nodes, b: _Nodes, cfg: EmbeddingConfig, same: bool, chunk: int = 1 << 16):
        self.a, self.b, self.cfg, self.same, self.chunk = a, b, cfg, same, chunk
        self.shift = 0 if same else len(a.x)
        self.links = np.zeros(self.shift + len(b.x), np.int64)
        self.label = np.arange(len(self.links))

    def _union(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[u], label[v]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label[:] = label[label]

    def _whole(self, a: int, b: int) -> None:
        rows, cols = np.arange(self.a.lo[a], self.a.hi[a]), self.shift + np.arange(self.b.lo[b], self.b.hi[b])
        self.links[rows] += self.b.weights[self.b.lo[b] : self.b.hi[b]].sum()
        self.links[cols] += self.a.weights[rows].sum()
        both = np.concatenate((rows, cols))
        self._union(both, np.full(len(both), rows[0]))

    def _decide(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle pairs of nodes (p of a, q of b); returns those that must be parted."""
        a, b, reach = self.a, self.b, self.cfg.reach
        cosine = np.einsum("ij,ij->i", a.x[a.center[p]], b.x[b.center[q]])
        apart, wide = _apart(cosine), a.radius[p] + b.radius[q]
        single = (a.count[p] == 0) & (b.count[q] == 0)
        hit = single & (cosine >= self.cfg.threshold)
        u, v = a.lo[p[hit]], self.shift + b.lo[q[hit]]
        np.add.at(self.links, u, b.weights[v - self.shift])
        np.add.at(self.links, v, a.weights[u])
        self._union(u, v)
        whole = ~single & (apart + wide <= reach - _SLACK)
        for x, y in zip(p[whole].tolist(), q[whole].tolist()):
            self._whole(x, y)
        open_ = ~single & ~whole & (apart - wide <= reach + _SLACK)
        return p[open_], q[open_]

    def _parted(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a, self.b
        left = (b.count[q] == 0) | ((a.count[p] > 0) & (a.radius[p] >= b.radius[q]))
        n = np.where(left, a.count[p], b.count[q])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, q, left = np.repeat(p, n), np.repeat(q, n), np.repeat(left, n)
        out_p, out_q = p.copy(), q.copy()
        out_p[left] = a.flat[a.first[p[left]] + at[left]]
        out_q[~left] = b.flat[b.first[q[~left]] + at[~left]]
        return out_p, out_q

    def _settle(self, p: np.ndarray, q: np.ndarray) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for k in range(self.chunk, len(p), self.chunk):
                todo.append((p[k : k + self.chunk], q[k : k + self.chunk]))
            p, q = self._decide(p[: self.chunk], q[: self.chunk])
            if len(p):
                todo.append(self._parted(p, q))

    def _tops(self, rows: np.ndarray, cols: np.ndarray, upper: bool) -> None:
        """Pairs of tops that aren't dropped. A matrix product in single precision screens them, with room for its error."""
        a, b = self.a, self.b
        if not len(rows) or not len(cols):
            return
        right, far = b.x[b.center[cols]].astype(np.float32).T, (self.cfg.reach + b.radius[cols]).astype(np.float32)
        for k in range(0, len(rows), 512):
            part = rows[k : k + 512]
            near = a.x[a.center[part]].astype(np.float32) @ right
            radius = a.radius[part].astype(np.float32)
            if radius.any() or (far > far[0]).any():
                wide = radius[:, None] + far
                near += wide * wide / 2
                i, j = np.nonzero(near >= np.float32(1 - _SCREEN))
            else:
                i, j = np.nonzero(near >= np.float32(1 - far[0] * far[0] / 2 - _SCREEN))
            p, q = part[i], cols[j]
            if upper:
                p, q = p[p < q], q[p < q]
            self._settle(p, q)

    def run(self) -> DualTraversal:
        """From the roots down. Lone points are held against each other apart from wider tops, whose bounds differ from pair to pair."""
        a, b = self.a, self.b
        gap = float(_apart(a.x[a.center[0]] @ b.x[b.center[0]])) - a.radius[0] - b.radius[0]
        if gap > self.cfg.reach + _SLACK:
            return self
        lone_a, lone_b = a.count[a.tops] == 0, b.count[b.tops] == 0
        self._tops(a.tops[lone_a], b.tops[lone_b], self.same)
        self._tops(a.tops[~lone_a], b.tops[~lone_b], self.same)
        self._tops(a.tops[~lone_a], b.tops[lone_b], False)
        if self.same:
            self._within(a.tops[~lone_a])
        else:
            self._tops(a.tops[lone_a], b.tops[~lone_b], False)
        return self

    def _within(self, nodes: np.ndarray) -> None:
        """Links inside each of some nodes of one tree."""
        a, todo = self.a, nodes.tolist()
        while todo:
            node = todo.pop()
            if 2 * a.radius[node] <= self.cfg.reach - _SLACK:
                rows = np.arange(a.lo[node], a.hi[node])
                self.links[rows] += a.weights[rows].sum() - a.weights[rows]
                self._union(rows, np.full(len(rows), rows[0]))
                continue
            below = a.flat[a.first[node] : a.first[node] + a.count[node]]
            todo += below[a.count[below] > 0].tolist()
            for k in range(len(below)):
                self._settle(np.full(len(below) - k - 1, below[k]), below[k + 1 :])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, smallest id connected) of the points that have a link."""
        ids = self.a.ids if self.same else np.concatenate((self.a.ids, self.b.ids))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        at = np.flatnonzero(self.links)
        return ids[at], self.links[at], least[self.label[at]]


_PLACED = "dim int, cell long, node long, weight long, far double, x binary"
_CELLS = "dim int, parent long, cell long, center binary"


def _columns(schema: str, values: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], [c.split()[0] for c in schema.split(", ")])


def _bytes(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in x]


def _points(nodes: DataFrame) -> DataFrame:
    """Usable vectors of nodes (node, weight, embedding), of length 1, all in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for dim, at, x in units(batch.column(2)):
                yield _columns(_PLACED, (np.full(len(x), dim), np.zeros(len(x)), node[at], weight[at], np.full(len(x), 2.0), _bytes(x)), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()))

    return nodes.select("node", "weight", "embedding").mapInArrow(run, _PLACED)


def _pivots(rows: DataFrame, large: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """(dim, parent, cell, center): for each large cell, vectors of a bounded sample that are far from each other."""
    some = rows.join(large, ["dim", "cell"]).where(F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / cfg.sample)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, cell), parts in grouped(batches, 2):
            block = pa.Table.from_batches(parts)
            x = np.frombuffer(b"".join(block.column("x").to_pylist())).reshape(-1, dim)
            wanted = max(2, min(cfg.pivots, len(x), int(block.column("n")[0].as_py()) // cfg.block))
            chosen, far = [0], _apart(x @ x[0])
            while len(chosen) < wanted and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, _apart(x @ x[chosen[-1]]))
            k = np.arange(len(chosen))
            yield _columns(_CELLS, (k * 0 + dim, k * 0 + cell, cell * (cfg.pivots + 2) + 1 + k, _bytes(x[chosen])), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))

    return some.select("dim", "cell", "n", "x").repartition("dim", "cell").sortWithinPartitions("dim", "cell").mapInArrow(run, _CELLS)


def _dealt(rows: DataFrame, large: DataFrame, pivots: DataFrame) -> DataFrame:
    """The vectors of large cells, each in the cell of its nearest pivot. A cell is dealt in pieces, and its pivots with each."""
    pieces = large.select("dim", "cell", F.ceil(F.col("n") * F.col("dim") / (1 << 21)).cast("int").alias("pieces"))
    each = rows.join(pieces, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("node", F.lit(5)), "pieces").cast("int").alias("piece"), F.lit(1).alias("kind"), "node", "weight", "x")
    centers = pivots.select("dim", F.col("parent").alias("cell"), F.col("cell").alias("node"), F.col("center").alias("x")).join(pieces, ["dim", "cell"])
    centers = centers.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), "node", F.lit(0).cast("long").alias("weight"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_), parts in grouped(batches, 3):
            block = pa.Table.from_batches(parts)
            kind, node, weight = (block.column(c).to_numpy() for c in ("kind", "node", "weight"))
            x = np.frombuffer(b"".join(block.column("x").to_pylist())).reshape(-1, dim)
            own, rest = kind == 0, kind == 1
            cells, centers = node[own], x[own]
            cosine = x[rest] @ centers.T
            nearest = cosine.argmax(axis=1)
            far = _apart(cosine[np.arange(len(nearest)), nearest])
            yield _columns(_PLACED, (np.full(len(far), dim), cells[nearest], node[rest], weight[rest], far, _bytes(x[rest])), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()))

    keys = ["dim", "cell", "piece"]
    return each.unionByName(centers).repartition(*keys).sortWithinPartitions(*keys, "kind", "node").mapInArrow(run, _PLACED)


def _near(pairs: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """The pairs of cells (dim, a, ra, ca, b, rb, cb: numbers, radii and centers) whose balls are near enough for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, ca, rb, cb = (batch.column(c).to_pylist() for c in ("ra", "ca", "rb", "cb"))
            keep = [u == v or _apart(np.frombuffer(u) @ np.frombuffer(v)) - r - q <= cfg.reach + _SLACK for r, u, q, v in zip(ra, ca, rb, cb)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def _descended(pairs: DataFrame, cells: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """Pairs of cells, those that were parted replaced by their children: a step of the dual traversal above the trees."""
    kids = lambda p, c, r, v: cells.select("dim", F.col("parent").alias(p), F.col("cell").alias(f"_{p}"), F.col("radius").alias(f"_{r}"), F.col("center").alias(f"_{v}"))
    both = pairs.join(kids("a", "cell", "ra", "ca"), ["dim", "a"], "left").join(kids("b", "cell", "rb", "cb"), ["dim", "b"], "left")
    new = {c: F.coalesce(f"_{c}", c) for c in ("a", "ra", "ca", "b", "rb", "cb")}
    once = (F.col("a") != F.col("b")) | (new["a"] <= new["b"])
    return _near(both.where(once).select("dim", *(v.alias(c) for c, v in new.items())), cfg)


def embedding_links(vectors: DataFrame, cfg: EmbeddingConfig = EmbeddingConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors: links at a cosine of threshold or more, all of them.

    1. Equal vectors become one node with a weight, so a vector of a third of all rows costs one.
    2. Nodes start in one cell. A cell that is too large is parted by pivots from a bounded sample of it, and each node goes
       to its nearest pivot's cell, until cells are small; a cell's radius is that of its farthest node. So the number of
       cells follows the number of vectors. A cell that pivots can't part is cut by hash.
    3. Each block of a cell becomes a cover tree.
    4. Pairs of cells are followed down these levels; those whose balls are too far apart are dropped. The rest are met tile
       by tile: a task holds the trees of some cells and meets those of others one at a time, so a tree is sent once for
       each tile, not for each pair. A pair of trees is traversed together and returns, for each node with a link, how
       many it has and the smallest node it is connected to: never the pairs.
    5. Counts are summed, and components closed over these connections.

    The work between cells that can't be dropped grows with the square of their nodes; on vectors without clusters that is an
    exact search's cost.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with null id, have no
    links (their component is their own id); vectors of different dimension are not linked; each vector of an id with several
    is one of its own, and each row has the result of its vector; a repeated row is the same vector; other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    component = T.ArrayType(T.DoubleType())
    plain = F.transform(F.col(vector_col).cast(component), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = in_small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), plain.alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    distinct = rows.where("vec_id is not null and embedding is not null").distinct().groupBy("h1", "h2", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")

    now = written(_points(nodes), "points")
    pairs = now.select("dim").distinct().select("dim", *(x for c in "ab" for x in (F.lit(0).cast("long").alias(c), F.lit(2.0).alias(f"r{c}"), F.lit(b"").alias(f"c{c}"))))
    leaves = []
    for _ in range(cfg.depth):
        large = now.groupBy("dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cfg.block)
        large = written(large, "large_cells")
        if large.isEmpty():
            break
        pivots = written(_pivots(now, large, cfg), "pivots")
        parted = pivots.select("dim", F.col("parent").alias("cell")).distinct()
        leaves.append(now.join(parted, ["dim", "cell"], "left_anti"))
        now = written(_dealt(now.join(parted, ["dim", "cell"], "left_semi"), large.join(parted, ["dim", "cell"], "left_semi"), pivots), "points")
        radii = now.groupBy("dim", "cell").agg(F.max("far").alias("radius"))
        pairs = written(_descended(pairs, pivots.join(radii, ["dim", "cell"]), cfg), "cell_pairs")
    points = now
    for leaf in leaves:
        points = points.unionByName(leaf)
    links = written(_met(pairs, points, cfg), "links")

    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    near = components(links, "node", "least")
    ids = near.join(nodes.select("node", "least"), "node")
    firsts = ids.join(ids.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", "first")
    known = points.select("node").join(nodes.drop("embedding"), "node").join(counts, "node", "left").join(firsts, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    found = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), found.alias("component_id"), found.eqNullSafe(F.col("vec_id")).alias("kept"))


def _met(pairs: DataFrame, points: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """(node, n, least): for each pair of trees of near cells, and within each tree, the nodes with links."""
    keys = ["dim", "cell", "sub"]
    sizes = points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("blocks"))
    dealt = points.join(sizes, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, cell, sub), parts in grouped(batches, 3):
            block = pa.Table.from_batches(parts)
            x = np.frombuffer(b"".join(block.column("x").to_pylist())).reshape(-1, dim)
            tree = CoverTree.build(x, block.column("node").to_numpy(), block.column("weight").to_numpy(), cfg).packed()
            yield _columns("dim int, cell long, sub int, tree binary", ([dim], [cell], [sub], [tree]), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))

    trees = dealt.select(*keys, "node", "weight", "x").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(plant, "dim int, cell long, sub int, tree binary")
    trees = written(trees, "trees")
    blocks, widest = trees.agg(F.count("*"), F.max("dim")).first()
    each = max(1, min(-(-blocks // 8), cfg.held_bytes // (cfg.block * (widest or 1) * 8)))
    tiles = max(1, -(-blocks // each))
    tile = lambda c: F.pmod(F.xxhash64("dim", c), F.lit(tiles)).cast("int")
    sided = pairs.select("dim", "a", "b", tile("a").alias("ta"), tile("b").alias("tb"))
    swap = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") > F.col("b")))
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    sided = written(sided.select("dim", pick("ta", "tb", "p"), pick("tb", "ta", "q"), pick("a", "b", "held"), pick("b", "a", "cell")), "tile_pairs")
    none = F.lit(None).cast("array<long>")
    held = sided.select("dim", "p", "q", F.lit(0).alias("side"), F.col("held").alias("cell")).distinct().withColumn("with", none)
    met = sided.groupBy("dim", "p", "q", "cell").agg(F.collect_list("held").alias("with")).select("dim", "p", "q", F.lit(1).alias("side"), "cell", "with")
    order = ["dim", "p", "q", "side", "cell", "sub"]
    rows = held.unionByName(met).join(trees, ["dim", "cell"]).select(*order, "with", "tree")
    parts = partitions_for(points.sparkSession, sided.select("dim", "p", "q").distinct().count(), 1, 4)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}
        for batch in batches:
            for dim, p, q, side, cell, sub, partners, tree in zip(*batch.columns):
                if (dim.as_py(), p.as_py(), q.as_py()) != now:
                    now, own = (dim.as_py(), p.as_py(), q.as_py()), {}
                key, nodes = (cell.as_py(), sub.as_py()), _Nodes(tree.as_py())
                if not side.as_py():
                    own[key] = nodes
                    continue
                near = set(partners.as_py())
                for other, held in own.items():
                    if other[0] in near and (other[0] != key[0] or other[1] <= key[1]):
                        found = DualTraversal(held, nodes if other != key else held, cfg, other == key).run().rows()
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "n", "least"])

    return rows.repartition(parts, "dim", "p", "q").sortWithinPartitions(*order).mapInArrow(meet, "node long, n long, least long")
