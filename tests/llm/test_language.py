import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.language_id import LanguageConfig, code_matrix, held_out, identify, ngrams, train
from lectern.llm.queries import QUERIES
from lectern.llm.shared import odd_constants

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and row[1] > 100 and 0 <= row[2] <= row[3] <= 1
    assert found.count() == 1000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, f"the cat and the dog number {k} ran of", "en") for k in range(40)] + [(k, f"der hund und die katze {k} ist nicht", "de") for k in range(40, 80)] + [(80, None, "en"), (None, "the dog", "en"), (81, "123 ###", None)], "doc_id long, text string, lang string")
    model = train(docs)
    assert model.languages == ["de", "en"]
    rows = {r.doc_id: r for r in identify(docs.withColumn("score", F.lit("x")), model).collect()}
    assert len(rows) == 83
    assert rows[80].lang_pred == "und" and rows[81].lang_pred == "und" and rows[81].score == 0.0
    assert rows[1].lang_pred == "en" and rows[41].lang_pred == "de" and rows[None].lang_pred == "en"
    long = identify(spark.createDataFrame([(1, "der hund " * 50_000)], "doc_id long, text string"), model).first()
    assert long.lang_pred == "de" and not long.ambiguous


def test_without_rows_or_languages(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert train(none) is None
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(one, train(one)).first().lang_pred == "und"
    single = spark.createDataFrame([(k, "abc def", "xx") for k in range(10)], "doc_id long, text string, lang string")
    assert identify(single, train(single)).first().lang_pred == "xx"


def test_codes():
    for n in (2, 3, 5, 12):
        code = code_matrix(n, 31)
        assert len({tuple(r) for r in code}) == n
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)
    cfg = LanguageConfig()
    every = lambda t: np.sort(np.concatenate([np.zeros(0, np.int64), *ngrams(t, cfg)]))
    assert len(every("")) == 0 and len(every("12 3")) == 0
    assert np.array_equal(every("Ab  c!"), every("ab c"))
    long = "".join(chr(97 + k * k % 23) for k in range(200_001))
    assert len(every(long)) == 3 * 200_003 - 3 and np.array_equal(every(long), np.sort(by_hand(long, cfg)))


def by_hand(text, cfg):
    """Buckets of n-grams, one at a time and with Python's own numbers."""
    mask, c = (1 << 64) - 1, [int(x) for x in odd_constants(2 * cfg.longest, 3)]
    words = "".join(x if x.isalpha() else " " for x in text.lower()).split()
    padded, out = [ord(x) for x in f" {' '.join(words)} "] if words else [], []
    for n in range(1, cfg.longest + 1):
        for k in range(len(padded) - n + 1):
            total = (c[cfg.longest + n - 1] + sum(padded[k + j] * c[j] for j in range(n))) & mask
            out.append(((total ^ (total >> 29)) * c[0] & mask) >> (64 - cfg.log2_buckets))
    return np.array(out, np.int64)


def brute(rows, cfg):
    """Languages and scores by sums over single n-grams; rows: (doc_id, text, lang)."""
    learned = [(t, lang) for d, t, lang in rows if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5]
    languages = sorted({lang for t, lang in learned if len(by_hand(t, cfg))})
    counts = {lang: Counter() for lang in languages}
    for t, lang in learned:
        counts[lang].update(by_hand(t, cfg).tolist())
    size = 1 << cfg.log2_buckets
    share = {lang: lambda b, n=sum(c.values()), c=c: (c[b] + cfg.smoothing) / (n + cfg.smoothing * size) for lang, c in counts.items()}
    code = code_matrix(len(languages), cfg.bits)
    mean = lambda b, x, sign: math.fsum(share[lang](b) for lang, row in zip(languages, code) if row[x] * sign > 0) / sum(row[x] * sign > 0 for row in code)

    def margins(text):
        grams = by_hand(text, cfg).tolist()
        return [math.fsum(math.log(mean(b, x, 1) / mean(b, x, -1)) for b in grams) / len(grams) for x in range(code.shape[1])] if grams else None

    right, wide, n = ({lang: [0.0] * code.shape[1] for lang in languages} for _ in range(3))
    for t, lang in learned:
        if (m := margins(t)) is not None:
            for x, v in enumerate(m):
                right[lang][x] += v * code[languages.index(lang)][x] > 0
                wide[lang][x] += abs(v)
                n[lang][x] += 1
    trust = [[max(right[lang][x] / n[lang][x] - 0.5, 1e-6) for x in range(code.shape[1])] for lang in languages]
    scale = [sum(wide[lang][x] / n[lang][x] for lang in languages) / len(languages) for x in range(code.shape[1])]
    out = {}
    for d, t, _ in rows:
        m = None if t is None else margins(t)
        if m is None:
            out[d] = ("und", 0.0)
            continue
        loss = [sum(w / sum(trust[k]) * math.log1p(math.exp(-4 * code[k][x] * m[x] / scale[x])) for x, w in enumerate(trust[k])) for k in range(len(languages))]
        first, second = sorted(range(len(languages)), key=lambda k: loss[k])[:2]
        out[d] = (languages[first], 1 - loss[first] / loss[second])
    return out


def test_against_brute_force(spark):
    rng, cfg = random.Random(3), LanguageConfig(log2_buckets=10)
    parts = {"aa": "ka ko mi ra", "bb": "sta pri ovo je", "cc": "the and ing of", "dd": "der die und ein", "ee": "que los para y", "ff": "ja on ei se"}
    for names in (["aa", "bb"], ["aa", "bb", "cc", "dd"], list(parts)):
        rows = [(k, " ".join(rng.choices(parts[lang].split(), k=6)) + rng.choice(["", " 12", "É!"]), lang) for k in range(60) for lang in [names[k % len(names)]]]
        rows += [(60, None, names[0]), (61, "", names[0]), (62, " 1 2", None), (63, "ka sta the der", None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        found = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, train(docs, cfg)).collect()}
        for d, (lang, score) in brute(rows, cfg).items():
            assert found[d][0] == lang and abs(found[d][1] - score) < 1e-4, d


def test_many_labels_repeats_and_no_rows(spark):
    rows = [(k, f"word{chr(97 + k % 26)} text", f"l{k % 20}") for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, "zz", "rare")] + [(k, "same text", "l0") for k in (7, 7, 7)], "doc_id long, text string, lang string")
    model = train(docs, LanguageConfig(most_languages=3))
    assert model.languages == ["l0", "l1", "l10"] or len(model.languages) == 3
    found = [r for r in identify(docs, model).collect() if r.text == "same text"]
    assert len(found) == 3 and len({(r.lang_pred, r.score) for r in found}) == 1
    assert identify(docs.limit(0), model).collect() == []


def test_held_out_share(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
