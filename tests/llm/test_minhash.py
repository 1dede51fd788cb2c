import collections
import random
import re

import numpy as np
from pyspark.sql import types as T

from lectern.llm.minhash_dedup import MinHashConfig, estimated_jaccard, near_duplicates, registers, shingles

SCHEMA = "doc_id long, text string, n_shingles string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=85):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "ONE two"), (n + 4, "one  TWO"), (n + 5, "É one"), (n + 6, "é one"), (n + 7, "x " * 60_000)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    found = {r.doc_id: r for r in near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}
    expected = brute(rows)
    assert len(found) == len(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_many_near_copies_in_small_blocks(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for n in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((n, " ".join(copy)))
    cfg = MinHashConfig(block_members=16, partners_per_task=8)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()}
    assert found == brute(rows)


def test_empty_and_null_ids_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.component_id, r.kept) for r in rows) == {(None, None, True): 1, (3, 3, True): 2, (5, 3, False): 1}


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    cfg = MinHashConfig()
    off = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
        ra, rb = (registers(x, cfg.buckets, cfg.mantissa_bits)[None] for x in (a, b))
        off.append(estimated_jaccard(ra, rb, np.array([len(a)]), np.array([len(b)]), cfg.mantissa_bits)[0] - 0.6)
    assert abs(np.mean(off)) < 0.02
    assert len(shingles(b"a b c d e f", 5)) == 2 and len(shingles(b"", 5)) == 0


def test_ids_with_several_texts_and_a_long_text(spark):
    base = [f"b{k}" for k in range(60)]
    a, near, other = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(reversed(base))
    long = " ".join(f"l{k}" for k in range(120_000))
    rows = [(5, a), (5, other), (2, near), (3, other), (3, other), (8, long), (9, long + " end")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = {(5, 56, 2, False): 1, (5, 56, 3, False): 1, (2, 56, 2, True): 1, (3, 56, 3, True): 2, (8, 119_996, 8, True): 1, (9, 119_997, 8, False): 1}
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected
