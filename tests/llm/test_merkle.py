import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm.merkle_manifest import LEAF_COLUMNS, MerkleConfig, leaf, manifest, ranked, sort_key

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, root string, r long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def walk(tree, at, fanout, node):
    beside = []
    for low in tree[:-1]:
        first = at - at % fanout
        run = low[first : first + fanout]
        beside += run[: at - first] + run[at - first + 1 :]
        node = h(*run[: at - first], node, *run[at - first + 1 :])
        at //= fanout
    return node, beside


def expected(docs, fanout=2, changed=lambda d: False):
    """docs (doc_id, source, lang, n_chars, text)."""
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    runs = {x: sorted((d for d in docs if d[2] == x), key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(*d))) for x in langs}
    trees = {x: levels([leaf_of(*d) for d in run], fanout) for x, run in runs.items()}
    top = levels([trees[x][-1][0] for x in langs], fanout)
    root, out = top[-1][0], []
    for place, x in enumerate(langs):
        for r, d in enumerate(runs[x]):
            own = leaf_of(*d)
            start = leaf_of(*d[:3], None if d[3] is None else d[3] + 1, d[4]) if changed(d) else own
            sub, low = walk(trees[x], r, fanout, start)
            folded, high = walk(top, place, fanout, sub)
            out.append((d[0], own, trees[x][-1][0], root, h(*low, *high), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, docs, cfg, tampered=None):
    rows = spark.createDataFrame([(t, d, x, s, n, "clash", 5) for d, s, x, n, t in docs], SCHEMA).repartition(5)
    return sorted(map(tuple, manifest(rows, cfg, tampered).collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-5 * n, 40 * n), n)
    return [(k, rng.choice(["s", "ü", None]), rng.choices(["en", "de", "é", "", None], [60, 20, 10, 5, 5])[0], rng.choice([None, 3, 999]), rng.choice([None, "", "text", "längerer Text"])) for k in ids]


@pytest.mark.parametrize("cfg", [MerkleConfig(), MerkleConfig(levels=2, digits=1, bucket=7), MerkleConfig(fanout=3, levels=2, bucket=20)])
def test_equals_a_tree_built_at_once(spark, cfg):
    docs = corpus(230, 4)
    assert found(spark, docs, cfg) == expected(docs, cfg.fanout)


def test_tampering_is_seen(spark):
    docs = corpus(120, 9)
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    got = found(spark, docs, MerkleConfig(levels=3), F.when(F.col("doc_id") % 3 == 0, leaf(changed)))
    assert got == expected(docs, 2, lambda d: d[0] % 3 == 0)
    assert {r[-1] for r in got} == {True, False}


def test_ids_at_the_ends_of_the_range_repeats_and_nulls(spark):
    row = (5, "s", "en", 1, "t")
    docs = [row] * 9 + [(5, "s", "en", 2, "t")] * 3 + [(None, None, "en", None, None)] * 6 + [(None, "x", "en", 1, "u"), (-(1 << 63), "s", "en", 1, "t"), ((1 << 63) - 1, "s", "en", 1, "t"), (0, "s", "en", 1, ""), (-1, "s", "en", 1, None)]
    for cfg in (MerkleConfig(), MerkleConfig(levels=2, digits=2, bucket=2)):
        assert found(spark, docs, cfg) == expected(docs)


def test_one_row_and_none(spark):
    docs = [(1, "s", None, 3, "abc")]
    assert found(spark, docs, MerkleConfig()) == [(1, leaf_of(*docs[0]), leaf_of(*docs[0]), leaf_of(*docs[0]), h(""), leaf_of(*docs[0]), True)]
    assert found(spark, [], MerkleConfig()) == []


def test_ranks_of_a_hot_run_of_keys(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id") * 1_000_003).alias("doc_id"), "id")
    keyed = rows.select("g", sort_key(F.col("doc_id"), F.lit("0" * 64), F.col("id")).alias("key"), "doc_id", "id")
    got = {r.id: r.r for r in ranked(keyed, MerkleConfig(digits=2, bucket=100)).collect()}
    assert got == {k: k for k in range(3000)}
