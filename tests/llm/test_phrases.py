import random
import re
from collections import Counter

import pytest

from lectern.llm.collocations import PhraseConfig, phrases

SCHEMA = "text string, lang string, id long, f string, rank string"


def expected(docs, cfg):
    """Every phrase counted at once."""
    lower = {c: c + 32 for c in range(65, 91)}
    counts = {}
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, cfg.longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(c for x, c in own.items() if len(x) == 1)
        frequent = {x: c for x, c in own.items() if len(x) > 1 and c >= cfg.least}
        rows = []
        for x, a in frequent.items():
            inside = lambda y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))  # noqa: B023, E731
            if any(len(y) > len(x) and 100 * c >= cfg.covered * a and inside(y) for y, c in frequent.items()):
                continue
            score, _, l, r = min((cfg.scale * a // (own[x[:k]] + own[x[k:]]), k, own[x[:k]], own[x[k:]]) for k in range(1, len(x)))  # noqa: E741
            rows.append((score, a, " ".join(x), l, r))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, k, p, a, l, r, n, s) for k, (s, a, p, l, r) in enumerate(rows[: cfg.top], 1)]  # noqa: E741
    return sorted(out)


def found(spark, docs, cfg, parts=6):
    rows = spark.createDataFrame([(t, x, 1, "clash", "clash") for x, t in docs], SCHEMA).repartition(parts)
    return sorted(map(tuple, phrases(rows, cfg).collect()))


def corpus(n, seed):
    rng = random.Random(seed)
    fixed = ["New York City", "in the middle of", "as well as", "über alles in", "a a a a"]
    words = ["the", "of", "Zoë", "and", "a", "x", "I", "\x1fodd", "nb\xa0sp"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice([rng.choice(fixed), *rng.choices(words, k=3)]) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rng.randrange(0, 40)))
        out.append((rng.choices(["en", "de", "und", None], [70, 15, 5, 10])[0], text))
    return out


@pytest.mark.parametrize("cfg", [PhraseConfig(least=3, chunk_words=50, top=7, salts=3), PhraseConfig(least=30, chunk_words=300), PhraseConfig(least=3, longest=3, covered=50)])
def test_equals_counting_every_phrase(spark, cfg):
    docs = corpus(250, 6)
    got = found(spark, docs, cfg)
    assert got == expected(docs, cfg) and got


def test_cuts_and_covered_phrases(spark):
    docs = [("en", "we met in new york city today; new york city")] * 20 + [("en", "new york times")] * 5 + [("en", "city hall")] * 60
    rows = {r[2]: r for r in found(spark, docs, PhraseConfig())}
    assert "new york" not in rows and "york city" not in rows and rows["new york city"][3:6] == (40, 45, 100)
    assert rows["city hall"][3:] == (60, 100, 60, 20 * 10 + 15 + 120, 2_000_000 * 60 // 160)


def test_nulls_empties_and_long_texts(spark):
    docs = [("en", None), ("en", ""), (None, " .,\t\n"), ("en", "one two " * 30_000)]
    assert found(spark, docs, PhraseConfig(top=5)) == expected(docs, PhraseConfig(top=5))
    assert found(spark, [("en", "a b")], PhraseConfig()) == [] and found(spark, [], PhraseConfig()) == []


def test_scores_are_exact_beyond_64_bits(spark):
    cfg = PhraseConfig(least=2, scale=10**17)
    docs = [("en", "a b a b a")] * 500 + [("en", "b c")]
    assert found(spark, docs, cfg) == expected(docs, cfg)
