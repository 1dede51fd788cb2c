"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import merkle_manifest, token_store
from lectern.llm.chat_format import ChatConfig, format_chats
from lectern.llm.collocations import PhraseConfig, phrases
from lectern.llm.decontaminate import DecontaminationConfig, contaminated
from lectern.llm.embedding_dedup import EmbeddingConfig, embedding_links
from lectern.llm.language_id import LanguageConfig, held_out, identify, train
from lectern.llm.license_scan import LicenseConfig, scan_licenses
from lectern.llm.lm_score import BackoffConfig, score
from lectern.llm.minhash_dedup import MinHashConfig, near_duplicates
from lectern.llm.packing import PackingConfig, pack
from lectern.llm.secret_scan import BASE_KINDS, SecretConfig, joined_spans, scan
from lectern.llm.warc_store import WarcConfig, round_trip
from lectern.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), MinHashConfig(threshold_percent=85))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs, LanguageConfig()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_warc_store(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = round_trip(pages, WarcConfig(), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"), ChatConfig())


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), DecontaminationConfig()).drop("text_key")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"), SecretConfig())
    counts = [F.expr(f"size(filter(kinds, k -> k = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(list(BASE_KINDS)), 256).alias("base_sha256"), joined_spans().alias("spans"))


def packing_config() -> PackingConfig:
    return PackingConfig(public_tokenizers.path("word_bpe_49k.json"), length=2048)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), packing_config())


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"), LicenseConfig()).drop("spans")


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links(table(spark, folder, "embeddings"), EmbeddingConfig(threshold=0.9))


def op11_token_store(spark: SparkSession, folder: str) -> DataFrame:
    cfg = token_store.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.round_trip(table(spark, folder, "documents"), cfg)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle_manifest.LEAF_COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle_manifest.leaf(changed))
    return merkle_manifest.manifest(docs, merkle_manifest.MerkleConfig(), tampered)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(table(spark, folder, "documents"), PhraseConfig())


def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(table(spark, folder, "documents"), BackoffConfig())
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


def op8_lm_score_order2(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(table(spark, folder, "documents"), BackoffConfig(order=2))
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_warc_store": op3_warc_store,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_secret_scan": op6_secret_scan,
    "op7_packing": op7_packing,
    "op8_lm_score": op8_lm_score,
    "op8_lm_score_order2": op8_lm_score_order2,
    "op9_license_scan": op9_license_scan,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_token_store": op11_token_store,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
}

_OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, w),
du AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
db AS (SELECT r, p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY r, p, w),
n AS (SELECT sum(len(ws)) AS n FROM d),
s AS (SELECT g.r, g.p IS NULL AS first, coalesce(b.c - db.c, 0) AS n_both, u.c - du.c AS own, pu.c - pdu.c AS before, greatest(1, n.n - len(d.ws)) AS rest
  FROM g JOIN d USING (r) CROSS JOIN n JOIN u ON u.w = g.w JOIN du ON du.r = g.r AND du.w = g.w
  LEFT JOIN u pu ON pu.w = g.p LEFT JOIN du pdu ON pdu.r = g.r AND pdu.w = g.p
  LEFT JOIN b ON b.p = g.p AND b.w = g.w LEFT JOIN db ON db.r = g.r AND db.p = g.p AND db.w = g.w),
v AS (SELECT r, sum(CASE WHEN n_both > 0 THEN ln(n_both) - ln(before) ELSE ln(greatest(own, 0.5) / rest) + CASE WHEN first THEN 0 ELSE ln(0.4) END END) AS x,
  count(*) FILTER (WHERE NOT first AND n_both <= 0) AS backed FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(v.backed, 0) AS BIGINT) AS n_backed_off, round(coalesce(v.x, 0.0), 4) AS log_score FROM d LEFT JOIN v USING (r)
"""

_OP8_3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS q FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w), du AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
b AS (SELECT p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, w), db AS (SELECT r, p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY r, p, w),
x AS (SELECT q, p, w, count(*) AS c FROM g WHERE q IS NOT NULL GROUP BY q, p, w), dx AS (SELECT r, q, p, w, count(*) AS c FROM g WHERE q IS NOT NULL GROUP BY r, q, p, w),
n AS (SELECT sum(len(ws)) AS n FROM d),
s AS (SELECT g.r, g.p, g.q, coalesce(x.c - dx.c, 0) AS three, coalesce(y.c - dy.c, 0) AS two_before, coalesce(b.c - db.c, 0) AS two, u.c - du.c AS own, pu.c - pdu.c AS before, greatest(1, n.n - len(d.ws)) AS rest
  FROM g JOIN d USING (r) CROSS JOIN n JOIN u ON u.w = g.w JOIN du ON du.r = g.r AND du.w = g.w
  LEFT JOIN u pu ON pu.w = g.p LEFT JOIN du pdu ON pdu.r = g.r AND pdu.w = g.p
  LEFT JOIN b ON b.p = g.p AND b.w = g.w LEFT JOIN db ON db.r = g.r AND db.p = g.p AND db.w = g.w
  LEFT JOIN b y ON y.p = g.q AND y.w = g.p LEFT JOIN db dy ON dy.r = g.r AND dy.p = g.q AND dy.w = g.p
  LEFT JOIN x ON x.q = g.q AND x.p = g.p AND x.w = g.w LEFT JOIN dx ON dx.r = g.r AND dx.q = g.q AND dx.p = g.p AND dx.w = g.w),
v AS (SELECT r, sum(CASE WHEN three > 0 THEN ln(three) - ln(two_before) ELSE CASE WHEN q IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN two > 0 THEN ln(two) - ln(before)
    ELSE ln(greatest(own, 0.5) / rest) + CASE WHEN p IS NULL THEN 0 ELSE ln(0.4) END END END) AS x,
  count(*) FILTER (WHERE p IS NOT NULL AND CASE WHEN q IS NULL THEN two ELSE three END <= 0) AS backed FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(v.backed, 0) AS BIGINT) AS n_backed_off, round(coalesce(v.x, 0.0), 4) AS log_score FROM d LEFT JOIN v USING (r)
"""

_OP1 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)), lambda k: array_to_string(ws[k:k + 4], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS s FROM h),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM m JOIN h x ON x.doc_id = a JOIN h y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
r(a, b) AS (SELECT doc_id, doc_id FROM h UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT h.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.c AS component_id, h.doc_id = c.c AS kept FROM h JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = h.doc_id
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, first, list_transform(range(8), lambda k: CAST(concat('0x', substr(x, CAST(5 * k + 1 AS BIGINT), 5)) AS INT)) AS v FROM p JOIN f USING (h))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda n: concat(
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 15) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 10) % 32 + 1, 1),
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 5) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n % 32 + 1, 1))), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""

_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP12 = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS v),
d AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS r, * FROM (SELECT doc_id, lang,
  sha256(concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-'), coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
  sha256(concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1), '-'), coalesce(concat(strlen(text), ':', text), '-'))) AS changed,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c // 256, v[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered FROM documents, t)),
b AS (SELECT lang, 0 AS level, list(leaf ORDER BY r) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(concat(nodes[k + 1], coalesce(nodes[k + 2], '')))) FROM b WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM b WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(concat(nodes[k + 1], coalesce(nodes[k + 2], '')))) FROM u WHERE len(nodes) > 1),
f AS (SELECT d.doc_id, d.r, d.lang, d.leaf, subroot, place, 0 AS level, 0 AS up, CASE WHEN tampered THEN changed ELSE leaf END AS h, '' AS proof FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang
  UNION ALL SELECT doc_id, r, f.lang, leaf, subroot, place, CASE WHEN len(b.nodes) > 1 THEN f.level + 1 ELSE f.level END, CASE WHEN len(b.nodes) > 1 THEN 0 ELSE up + 1 END,
    CASE WHEN len(b.nodes) > 1 THEN sha256(CASE WHEN (r >> f.level) % 2 = 1 THEN concat(b.nodes[r >> f.level], h) ELSE concat(h, coalesce(b.nodes[(r >> f.level) + 2], '')) END)
      ELSE sha256(CASE WHEN (place >> up) % 2 = 1 THEN concat(u.nodes[place >> up], h) ELSE concat(h, coalesce(u.nodes[(place >> up) + 2], '')) END) END,
    concat(proof, CASE WHEN len(b.nodes) > 1 THEN CASE WHEN (r >> f.level) % 2 = 1 THEN b.nodes[r >> f.level] ELSE coalesce(b.nodes[(r >> f.level) + 2], '') END
      ELSE CASE WHEN (place >> up) % 2 = 1 THEN u.nodes[place >> up] ELSE coalesce(u.nodes[(place >> up) + 2], '') END END)
  FROM f JOIN b ON b.lang IS NOT DISTINCT FROM f.lang AND b.level = f.level LEFT JOIN u ON u.level = f.up WHERE len(b.nodes) > 1 OR len(u.nodes) > 1),
z AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f, z QUALIFY row_number() OVER (PARTITION BY lang, r ORDER BY level DESC, up DESC) = 1
"""

_OP13 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS x FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, x, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, x, f, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 30),
t AS (SELECT c.lang, c.k, c.x, c.f AS a, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.x = c.x[1:cut] JOIN f r ON r.lang = c.lang AND r.x = c.x[cut + 1:c.k]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.x ORDER BY score, cut) = 1),
o AS (SELECT lang, x[i:i + m - 1] AS x, max(a) AS g FROM t, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
e AS (SELECT t.*, array_to_string(t.x, ' ') AS phrase FROM t LEFT JOIN o ON o.lang = t.lang AND o.x = t.x WHERE o.g IS NULL OR CAST(100 AS HUGEINT) * o.g < CAST(80 AS HUGEINT) * t.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM e JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": _OP1,
    "op3_warc_store": _OP3,
    "op8_lm_score": _OP8_3,
    "op8_lm_score_order2": _OP8,
    "op10_embedding_dedup": _OP10,
    "op12_merkle_manifest": _OP12,
    "op13_collocations": _OP13,
}
