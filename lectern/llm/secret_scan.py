"""Secrets in texts, with a ledger of blobs: each content is scanned once by each version of each rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import in_small_batches, scratch_path, settings, written

#: Base kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")

#: The base rules, and the spans that this method adds. (kind, pattern, group, least length of the group)
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    # the body ends before the next BEGIN or END, so a text is read once; without END, what looks like headers and body is taken
    ("pem", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----|(?:\s+(?:Proc-Type|DEK-Info):[^\n]*|\s+[A-Za-z0-9+/=]{16,}(?!\S))*)", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]+:[^\s/:@]+@", 0, 1),
)


@dataclass(frozen=True)
class SecretConfig:
    """rules: the text of each is its version, so a changed rule makes every blob unseen by it, and only by it."""

    rules: tuple[tuple[str, str, int, int], ...] = field(default=RULES)

    @property
    def versions(self) -> list[str]:
        return [hashlib.sha256(repr(rule).encode()).hexdigest()[:16] for rule in self.rules]


#: Literals of which a text must hold one (in lower case) for a rule to match; others are always tried.
_NEEDED = {"assign": ("password", "passwd", "secret", "token", "api"), "pem": ("private key",), "jwt": ("eyj",), "url": ("://",), "access": ("akia",)}
#: The same maximal runs as the base rule, without stopping at short ones.
_LONG_RUNS = {"hex": re.compile(r"[0-9a-f]{24,}"), "access": re.compile(r"AKIA[A-Z0-9]{16,}")}


class Scanner:
    def __init__(self, cfg: SecretConfig):
        self.rules = []
        for kind, pattern, group, least in cfg.rules:
            own = (kind, pattern, group, least) in RULES
            flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
            fast = _LONG_RUNS.get(kind) if own else None
            self.rules.append((kind, fast or re.compile(pattern, flags), 0 if fast else group, 1 if fast else least, _NEEDED.get(kind, ()) if own else ()))

    def found(self, text: str, rules: set[int] | None = None) -> list[tuple[int, int, str, int]]:
        """(start, number of the rule, kind, end), sorted, of some rules or all; leftmost and non-overlapping in each kind."""
        low, found = text.lower(), []
        for order, (kind, pattern, group, least, needed) in enumerate(self.rules):
            if (rules is None or order in rules) and (not needed or any(x in low for x in needed)):
                found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
        return sorted(found)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then in the order of the rules."""
        return [(kind, start, end) for start, _, kind, end in self.found(text)]


def blob_id(text: F.Column) -> F.Column:
    """Content address: SHA-256 of the UTF-8 bytes; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


_LEDGER = "blob binary, rules array<string>, found array<string>, kinds array<string>, starts array<int>, ends array<int>"


def _scanned(blobs: DataFrame, cfg: SecretConfig) -> DataFrame:
    """A ledger row for each of blobs (blob, text, rules): the rule versions it was scanned by, and by which each span was found."""
    versions = cfg.versions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(cfg)
        for batch in batches:
            rows = []
            for text, rules in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows.append([(versions[n], kind, start, end) for start, n, kind, end in scanner.found(text or "", {versions.index(r) for r in rules})])
            lists = [pa.array([[span[k] for span in row] for row in rows], pa.list_(t)) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["blob", "rules", "found", "kinds", "starts", "ends"])

    return in_small_batches(blobs).select("blob", "text", "rules").mapInArrow(run, _LEDGER)


def _findings(ledger: DataFrame, versions: list[str]) -> DataFrame:
    """(blob, kinds, starts, ends) of blobs with a span of the current rules, from all scans of a blob, in the order of spans."""
    span = F.transform(F.arrays_zip("found", "kinds", "starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), F.array_position(F.array(*map(F.lit, versions)), x["found"]).alias("rule"), x["kinds"].alias("kind"), x["ends"].alias("end")))
    own = ledger.where(F.size("kinds") > 0).select("blob", F.filter(span, lambda x: x["rule"] > 0).alias("spans")).where(F.size("spans") > 0)
    every = own.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return every.select("blob", F.col("spans.kind").alias("kinds"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def scan(docs: DataFrame, cfg: SecretConfig = SecretConfig(), ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, kinds, starts, ends) for each row of docs; starts and ends in code points, ends exclusive.

    1. Every row is content-addressed; only the address and the row's id go on.
    2. Addresses that the ledger lacks for some version of a rule are kept with those rules, and the smallest id that has each.
    3. The text of that one row is scanned by the rules it lacks, and the ledger gets a row for it, whether or not it holds
       a secret.
    4. The ledger's findings are joined back to every row. A blob without a finding needs no join partner, so only
       blobs that hold secrets are joined, in a join that adaptive execution can split for a content with many copies.

    Where much is unseen, as at first, step 3 shuffles the texts, repeated ones too, to drop those that aren't to be
    scanned; where little is, Spark sends the list of the unseen to the texts instead.

    ledger: a folder (Parquet) kept from run to run; a new version of a document costs one scan, an unchanged one none.
    Defined cases: null text is empty; rows with a null id are content-addressed and scanned too; a repeated row comes
    back as often; an id with two texts has a row for each; other columns are ignored; no rows give no rows.
    """
    spark, versions = docs.sparkSession, cfg.versions
    ledger = ledger or scratch_path(spark, "ledger")
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = spark.read.schema(_LEDGER).parquet(ledger) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    addressed = written(texts.select("doc_id", blob_id(F.col("text")).alias("blob")), "versions")

    current = F.array(*map(F.lit, versions)).cast("array<string>")
    unseen = addressed.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).withColumn("rules", current)
    if known is not None:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = unseen.join(seen, "blob", "left").withColumn("rules", F.when(F.col("seen").isNull(), current).otherwise(F.array_except(current, "seen"))).drop("seen")
    unseen = unseen.where(F.size("rules") > 0)
    # an id may have several texts, so the address is held against the text that the id leads to
    named = texts.join(unseen.where("doc_id is not null"), "doc_id").where(blob_id(F.col("text")) == F.col("blob")).select("blob", "text", "rules")
    lone = texts.where("doc_id is null").join(unseen.where("doc_id is null").select(F.col("blob").alias("own"), "rules"), blob_id(F.col("text")) == F.col("own")).select(F.col("own").alias("blob"), "text", "rules")
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        _scanned(named.unionByName(lone), cfg).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)

    joined = addressed.join(_findings(spark.read.schema(_LEDGER).parquet(ledger), versions), "blob", "left")
    empty = F.array().cast("array<string>"), F.array().cast("array<int>"), F.array().cast("array<int>")
    return joined.select("doc_id", "blob", *(F.coalesce(c, e).alias(c) for c, e in zip(("kinds", "starts", "ends"), empty)))


def joined_spans(kinds: list[str] | None = None) -> F.Column:
    """kind:start:end of all spans, or of those of some kinds, comma-joined."""
    each = F.arrays_zip("kinds", "starts", "ends")
    if kinds:
        each = F.filter(each, lambda x: x["kinds"].isin(*kinds))
    return F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span that scan found replaced by [kind]; overlapping spans become one.

    Findings are held against a row's content, so that repeated ids do no harm. Rows without a span stay as they are.
    """
    spans = written(found.where(F.size("kinds") > 0).select(F.col("blob").alias("_blob"), F.col("kinds").alias("_kinds"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends")).dropDuplicates(["_blob"]), "findings")
    joined = docs.join(spans, blob_id(F.col(text_col)) == F.col("_blob"), "left")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (kinds, starts, ends) = batch.column(at).to_pylist(), (batch.column(f"_{c}").to_pylist() for c in ("kinds", "starts", "ends"))
            for k, text in enumerate(texts):
                if kinds[k] and text is not None:
                    texts[k] = redacted(text, list(zip(kinds[k], starts[k], ends[k])))
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_small_batches(joined).select(*(docs[c] for c in names), "_kinds", "_starts", "_ends").mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(out) + text[done:]
