import numpy as np
import pytest

from lectern.llm.embedding_dedup import EmbeddingConfig, embedding_links
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, n_links string"


def brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            good[i] = v / np.linalg.norm(v)
    ids = sorted(good)
    links = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in ids}
    out = {}
    for i in [r[0] for r in rows]:
        if i not in links:
            out[i] = (0, i)
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def clusters(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 12), dim))
    return [(k, (centers[rng.integers(len(centers))] + rng.normal(size=dim) * spread).tolist()) for k in range(n)]


@pytest.mark.parametrize("dim,spread,threshold", [(3, 0.05, 0.9), (8, 0.25, 0.9), (32, 0.3, 0.9), (5, 0.4, 0.99), (4, 0.3, 0.5)])
def test_against_brute_force(spark, dim, spread, threshold):
    rows = clusters(300, dim, dim, spread)
    cfg = EmbeddingConfig(threshold=threshold, block=40, sample=100, pivots=6)
    found = embedding_links(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), cfg).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.0]), (11, [1e300, 1e299]), (12, [-1.0, 0.0])]
    rows += [(100 + k, [0.6, 0.8]) for k in range(50)]
    found = embedding_links(spark.createDataFrame([(*r, "") for r in [*rows, (None, [1.0, 0.0]), (2, [2.0, 0.0])]], SCHEMA), EmbeddingConfig(block=8)).collect()
    expected = brute(rows)
    assert len(found) == len(rows) + 2
    assert all((r.n_links, r.component_id) == expected[r.vec_id] for r in found if r.vec_id is not None)
    alone = next(r for r in found if r.vec_id is None)
    assert (alone.n_links, alone.component_id, alone.kept) == (0, None, True)


def test_every_vector_of_an_id_counts(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (4, [-1.0, -0.0])]
    found = embedding_links(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]


def test_levels_of_cells_and_a_hot_vector(spark):
    rows = clusters(700, 6, 9, 0.2) + [(1000 + k, [0.5] * 6) for k in range(400)] + [(2000 + k, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5 + k / 1e6]) for k in range(100)]
    cfg = EmbeddingConfig(block=16, sample=40, pivots=3, held_bytes=16 * 6 * 8 * 4)
    found = embedding_links(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(7), cfg).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows)


def test_empty(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).collect() == []
    assert embedding_links(spark.createDataFrame([(1, None, "")], SCHEMA)).first().n_links == 0


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    expected = brute([(r.vec_id, list(r.embedding)) for r in table])
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_embedding_dedup"](spark, SF).collect()} == expected


def near_threshold(spread, seed):
    """Tight clusters whose members lie on both sides of the threshold from each other, and the case of three vectors in a plane."""
    rng, reach = np.random.default_rng(seed), float(np.sqrt(0.2))
    turned = lambda chord: 2 * np.arcsin(chord / 2)
    rows = []
    for c in range(6):
        base = rng.uniform(0, 2 * np.pi)
        angles = [base + a for a in rng.normal(size=6) * spread] + [base + turned(reach) + a for a in rng.normal(size=6) * spread]
        rows += [[np.cos(a), np.sin(a)] + [0.0] * c for a in angles]
    for first, second in ((8e-9, 5e-9), (-8e-9, -5e-9)):
        rows += [[np.cos(a), np.sin(a)] + [0.0] * 7 for a in (0.0, first, turned(reach + second))]
    return [(k, [float(x) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("spread", [1e-9, 1e-8, 1e-7, 1e-6])
def test_links_at_the_threshold_are_decided_by_cosine(spark, spread):
    rows = near_threshold(spread, 5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), EmbeddingConfig()).collect()}
    assert got == brute(rows)
    assert len({n for n, _ in got.values()}) > 2
