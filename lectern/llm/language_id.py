"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import in_small_batches, odd_constants

UNDETERMINED = "und"

#: Letters of which the n-grams are made and looked up at a time: a long text costs twelve bytes a character, and no more for them.
_SLICE = 1 << 16


@dataclass(frozen=True)
class LanguageConfig:
    """sample_per_language: expected number of labelled rows of each language from which the classifiers are fitted
    (all of a language that has fewer); the bound of the fit. Predictions read every row.

    bits: columns of the code for more than five languages; up to five, every possible column is used.
    most_languages: values of the label that are learned, those with most rows, which bounds the model and what the driver
    gathers for it; other labels are never predicted.
    ambiguous_below: a prediction whose score is smaller is flagged as ambiguous.
    """

    log2_buckets: int = 15
    longest: int = 3
    sample_per_language: int = 2000
    smoothing: float = 0.5
    bits: int = 31
    most_languages: int = 500
    ambiguous_below: float = 0.05


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters_of(text: str) -> np.ndarray:
    """Code points of one text, lower-cased, with a blank before, after, and for every run of other characters. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    runs = np.where(letter, points, np.uint32(32))[keep]
    return np.concatenate(([32], runs, [32][: int(runs[-1] != 32)])).astype(np.uint32)


def ngrams(text: str, cfg: LanguageConfig) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of one text, some at a time."""
    padded, c = _letters_of(text), odd_constants(2 * cfg.longest, 3)
    for at in range(0, len(padded), _SLICE):
        part = padded[at : at + _SLICE + cfg.longest - 1].astype(np.uint64)
        for n in range(1, cfg.longest + 1):
            size = min(_SLICE, len(padded) - at - n + 1)
            if size <= 0:
                continue
            total = np.full(size, c[cfg.longest + n - 1])
            for k in range(n):
                total += part[k : size + k] * c[k]
            total = (total ^ (total >> np.uint64(29))) * c[0]
            yield (total >> np.uint64(64 - cfg.log2_buckets)).astype(np.int64)


def code_matrix(languages: int, bits: int) -> np.ndarray:
    """A codeword of +1 and -1 for each language.

    Up to five languages, every way to part them is a column; beyond that, the best of several random
    matrices by the smallest distance between two codewords.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = np.arange(1, 2 ** (languages - 1))
        return np.where((columns[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    best, gap, rng = None, -1.0, np.random.default_rng(7)
    for _ in range(40):
        code = np.stack([rng.permutation(np.where(np.arange(languages) % 2, 1.0, -1.0)) for _ in range(bits)], axis=1)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    """languages: sorted. weights: log-odds of each bucket for each bit. scales: of a bit's margins. trust: of each bit for each language."""

    cfg: LanguageConfig
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray | None:
        """Mean log-odds of each bit's classifier; None for a text without letters."""
        total, count = np.zeros(self.weights.shape[1]), 0
        for grams in ngrams(text, self.cfg):
            total += self.weights[grams].sum(axis=0, dtype=np.float64)
            count += len(grams)
        return total / count if count else None

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        """The nearest codeword under the weighted logistic loss, and how far it is ahead of the second: 0 (as near) to 1."""
        if len(self.languages) < 2:
            return self.languages[0], 1.0
        loss = (self.trust * np.logaddexp(0.0, -4.0 * self.code * (margins / self.scales))).sum(axis=1)
        first, second = np.argsort(loss, kind="stable")[:2]
        return self.languages[first], float(np.clip(1.0 - loss[first] / max(loss[second], 1e-300), 0.0, 1.0))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: a fifth, by the checksum of the id; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, cfg: LanguageConfig, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    labelled = in_small_batches(docs).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    sizes = {r.lang: r.n for r in rows.orderBy(F.desc("n"), "lang").limit(cfg.most_languages).collect()}
    if not sizes:
        return labelled.limit(0).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = F.try_element_at(F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)), F.col(lang_col).cast("string"))
    chosen = F.pmod(F.xxhash64(F.col(id_col)), size) < cfg.sample_per_language
    return labelled.where(chosen & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def train(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit the binary classifiers on labelled rows that aren't held out; None if no such row has a letter.

    Counts and the classifiers' accuracies are summed on Spark. The driver gets a row for each language and
    bucket, and one for each language and bit, whatever the size of docs.
    """
    sample, buckets = _sample(docs, cfg, id_col, text_col, lang_col), 1 << cfg.log2_buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grams in ngrams(text, cfg):
                    sums.setdefault(lang, np.zeros(buckets, np.int64))
                    sums[lang] += np.bincount(grams, minlength=buckets)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), buckets))
    counts[np.searchsorted(languages, rows["lang"]), rows["bucket"]] = rows["n"]
    share = (counts + cfg.smoothing) / (counts.sum(axis=1, keepdims=True) + cfg.smoothing * buckets)
    code = code_matrix(len(languages), cfg.bits)
    weights = np.zeros((buckets, code.shape[1]), np.float32)
    if len(languages) > 1:
        for b in range(code.shape[1]):
            weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    bits = code.shape[1]
    raw = LanguageModel(cfg, languages, code, weights, np.ones(bits), np.ones_like(code))
    held = docs.sparkSession.sparkContext.broadcast(raw)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = held.value, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in model.languages and (m := model.margins(text)) is not None:
                    right = m * model.code[model.languages.index(lang)] > 0
                    sums.setdefault(lang, np.zeros((3, bits)))
                    sums[lang] += np.stack([np.ones(bits), right, np.abs(m)])
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * bits), pa.array(range(bits), pa.int32()), *map(pa.array, s)], ["lang", "bit", "n", "right", "size"])

    judged = sample.mapInArrow(judge, "lang string, bit int, n double, right double, size double")
    judged = judged.groupBy("lang", "bit").agg(*(F.sum(c).alias(c) for c in ("n", "right", "size"))).toPandas()
    right, size = np.zeros_like(code), np.zeros_like(code)
    at = (np.searchsorted(languages, judged["lang"]), judged["bit"])
    right[at], size[at] = judged["right"] / judged["n"], judged["size"] / judged["n"]
    trust = np.maximum(right - 0.5, 1e-6)
    return LanguageModel(cfg, languages, code, weights, np.maximum(size.mean(axis=0), 1e-9), trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous. One pass over whole texts, without a shuffle.

    Defined cases: null text, and text without a letter, gives "und" with score 0, not ambiguous; without a model,
    "und" for every row; at equal losses the first language by name. Repeated rows each get the same answer. Columns of docs
    with these names are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    at = kept.index(text_col)
    docs = in_small_batches(docs).select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double, ambiguous boolean"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            lang, score, unsure = [], [], []
            for text in batch.column(at).to_pylist():
                margins = None if model is None or text is None else model.margins(text)
                found, sure = (UNDETERMINED, 0.0) if margins is None else model.decode(margins)
                lang.append(found)
                score.append(sure)
                unsure.append(margins is not None and sure < model.cfg.ambiguous_below)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)
