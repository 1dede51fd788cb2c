"""The library's tables as views over a data folder's tables, so that every query can run on it.

FIXTURES.md states each view. A reader of real tables passes those instead; no operator depends on this module.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import lexical, vector_table
from lectern.plans import telemetry
from lectern.tables import fingerprint, shared_dir, table

AS_OF = "2024-12-31 00:00:00"


@dataclass
class Corpus:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def lexicon(self) -> lexical.LexicalIndex:
        """The stored index of the papers' words, built when it is first asked for; other tables have another one."""
        path = f"{shared_dir(self.spark)}/lexicon-{fingerprint(self.spark, self.folder.rstrip('/') + '/documents.parquet')}"
        found = lexical.open_index(self.spark, path)
        if found is None:
            lexical.build_index(self.papers, path)
            found = lexical.open_index(self.spark, path)
        return found

    @cached_property
    def vectors(self) -> DataFrame:
        """The blocks of the stored vector table, written when it is first asked for."""
        path = f"{shared_dir(self.spark)}/vectors-{fingerprint(self.spark, self.folder.rstrip('/') + '/embeddings.parquet')}"
        if vector_table.current(self.spark, path) is None:
            vector_table.write(self.embeddings, path, "given")
        return vector_table.current(self.spark, path)[1]

    @property
    def papers(self) -> DataFrame:
        number = F.col("doc_id").cast("string")
        published = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp_ntz")
        code = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://github.com/"), "source", F.lit("/p"), number, F.lit(".git")))
        arxiv = F.concat(F.lit("2401."), F.lpad(number, 5, "0"))
        return self.documents.select(F.col("doc_id").alias("paper_id"), arxiv.alias("arxiv_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("primary_category"), published.alias("published_utc"), code.alias("code_url"))

    @property
    def paper_categories(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("paper_id"), F.explode(F.array("lang", "source")).alias("category"))

    @property
    def signals(self) -> DataFrame:
        return self.documents.where(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("paper_id"), (F.col("n_chars") % 1500).cast("int").alias("citation_count"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector"))

    @property
    def analyses(self) -> DataFrame:
        score = (F.col("quality") * 60 + F.col("toxic") * 25 + F.col("doc_id") % 15).cast("double")
        return self.table("labels").select(F.lit(1).cast("long").alias("user_id"), F.col("doc_id").alias("paper_id"), F.lit(2).alias("schema_version"), (1 + F.col("doc_id") % 2).cast("int").alias("profile_version"), score.alias("composite_score"))

    @property
    def judgments(self) -> DataFrame:
        graded = self.table("labels").join(self.documents.select("doc_id", "lang"), "doc_id")
        source = F.when(F.col("doc_id") % 3 == 0, "random").otherwise("pool")
        return graded.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("grade"), source.alias("source"))

    @property
    def calibration(self) -> DataFrame:
        grade = (F.col("quality") * 2 + F.col("toxic")).cast("int")
        return self.table("labels").select(F.col("doc_id").alias("paper_id"), grade.alias("orig"), F.when(F.col("doc_id") % 5 == 0, 3 - grade).otherwise(grade).alias("cal"))

    @property
    def searches(self) -> DataFrame:
        return self.table("events").where("event_type = 'view'").select(F.col("event_id").alias("search_event_id"), "user_id", F.col("ts").alias("created_utc"))

    @property
    def slots(self) -> DataFrame:
        """Twelve shown papers for each search; the number of documents is a scalar of the folder."""
        count = self.documents.count()
        ranked = self.searches.select("search_event_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank"))
        paper = (F.col("search_event_id") * 7 + F.col("rank") * 13) % count
        nearness = F.when(F.col("rank") % 3 == 0, "close").when(F.col("rank") % 3 == 1, "stretch")
        return ranked.select("search_event_id", "rank", paper.alias("paper_id"), (F.col("rank") > 10).alias("is_wildcard"), nearness.alias("proximity"), F.when(F.col("rank") % 2 == 0, "A").otherwise("B").alias("variant"))

    @property
    def interactions(self) -> DataFrame:
        """Events that aren't searches, with the user's latest earlier search that showed the paper, and its rank there."""
        count = self.documents.count()
        kind = F.when(F.col("event_type") == "click", "Bookmarked").when(F.col("event_type") == "purchase", "AnalyzedFromSearch").when(F.col("event_type") == "error", "NotInterested").otherwise("Unbookmarked")
        acts = self.table("events").where("event_type <> 'view'").select(F.col("event_id").alias("interaction_id"), "user_id", F.col("ts").alias("acted_utc"), kind.alias("type"), (F.col("event_id") % count).alias("paper_id"))
        shown = self.searches.join(self.slots.select("search_event_id", "paper_id", "rank"), "search_event_id")
        seen = acts.join(shown, ["user_id", "paper_id"], "left")
        earlier = F.when(F.col("created_utc") < F.col("acted_utc"), F.struct("created_utc", "search_event_id", "rank"))
        return seen.groupBy("interaction_id", "user_id", "acted_utc", "type", "paper_id").agg(F.max(earlier).alias("s")).select("interaction_id", "user_id", "acted_utc", "type", "paper_id", F.col("s.search_event_id").alias("search_event_id"), F.col("s.rank").alias("rank"))

    @property
    def grants(self) -> DataFrame:
        return self.table("events").where("event_type = 'signup'").select("user_id", F.floor(F.col("value") * 10000).cast("long").alias("amount_micros"))

    @property
    def usage(self) -> DataFrame:
        return self.table("events").where("event_type in ('click', 'purchase')").select("user_id", F.col("ts").alias("created_utc"), F.floor(F.col("value") * 1000).cast("long").alias("cost_micros"), (F.col("event_id") % 5 == 0).alias("used_byo_key"))

    @property
    def bookmarks(self) -> DataFrame:
        return telemetry.bookmarks(self.interactions)

    @property
    def logged_queries(self) -> DataFrame:
        return self.table("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query_text"))


#: The same views in DuckDB's SQL, for the oracle.
SQL = """
papers AS (SELECT doc_id AS paper_id, concat('2401.', lpad(CAST(doc_id AS VARCHAR), 5, '0')) AS arxiv_id, substr(text, 1, 60) AS title, text AS abstract, lang AS primary_category,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS TIMESTAMP) AS published_utc, CASE WHEN doc_id % 4 = 0 THEN concat('https://github.com/', source, '/p', CAST(doc_id AS VARCHAR), '.git') END AS code_url FROM documents),
paper_categories AS (SELECT doc_id AS paper_id, lang AS category FROM documents UNION ALL SELECT doc_id, source FROM documents),
signals AS (SELECT doc_id AS paper_id, CAST(n_chars % 1500 AS INT) AS citation_count FROM documents WHERE doc_id % 3 <> 0),
paper_embeddings AS (SELECT vec_id AS paper_id, embedding AS vector FROM embeddings),
analyses AS (SELECT CAST(1 AS BIGINT) AS user_id, doc_id AS paper_id, 2 AS schema_version, CAST(1 + doc_id % 2 AS INT) AS profile_version, CAST(quality * 60 + toxic * 25 + doc_id % 15 AS DOUBLE) AS composite_score FROM labels),
judgments AS (SELECT d.lang AS query_id, l.doc_id AS paper_id, CAST(quality * 2 + toxic AS INT) AS grade, CASE WHEN l.doc_id % 3 = 0 THEN 'random' ELSE 'pool' END AS source FROM labels l JOIN documents d USING (doc_id)),
calibration AS (SELECT doc_id AS paper_id, CAST(quality * 2 + toxic AS INT) AS orig, CAST(CASE WHEN doc_id % 5 = 0 THEN 3 - (quality * 2 + toxic) ELSE quality * 2 + toxic END AS INT) AS cal FROM labels),
searches AS (SELECT event_id AS search_event_id, user_id, ts AS created_utc FROM events WHERE event_type = 'view'),
slots AS (SELECT search_event_id, CAST(r AS INT) AS rank, (search_event_id * 7 + r * 13) % (SELECT count(*) FROM documents) AS paper_id, r > 10 AS is_wildcard,
  CASE r % 3 WHEN 0 THEN 'close' WHEN 1 THEN 'stretch' END AS proximity, CASE r % 2 WHEN 0 THEN 'A' ELSE 'B' END AS variant FROM searches, (SELECT unnest(range(1, 13)) AS r)),
acts AS (SELECT event_id AS interaction_id, user_id, ts AS acted_utc, CASE event_type WHEN 'click' THEN 'Bookmarked' WHEN 'purchase' THEN 'AnalyzedFromSearch' WHEN 'error' THEN 'NotInterested' ELSE 'Unbookmarked' END AS type,
  event_id % (SELECT count(*) FROM documents) AS paper_id FROM events WHERE event_type <> 'view'),
interactions AS (SELECT interaction_id, user_id, acted_utc, type, paper_id, search_event_id, rank FROM (SELECT a.*, s.search_event_id, s.rank, row_number() OVER (PARTITION BY a.interaction_id ORDER BY s.created_utc DESC NULLS LAST, s.search_event_id DESC) AS n
  FROM acts a LEFT JOIN (SELECT searches.*, slots.paper_id AS pid, slots.rank FROM searches JOIN slots USING (search_event_id)) s ON s.user_id = a.user_id AND s.pid = a.paper_id AND s.created_utc < a.acted_utc) WHERE n = 1),
grants AS (SELECT user_id, CAST(floor(value * 10000) AS BIGINT) AS amount_micros FROM events WHERE event_type = 'signup'),
usage AS (SELECT user_id, ts AS created_utc, CAST(floor(value * 1000) AS BIGINT) AS cost_micros, event_id % 5 = 0 AS used_byo_key FROM events WHERE event_type IN ('click', 'purchase')),
bookmarks AS (SELECT user_id, paper_id, acted_utc AS created_utc FROM (SELECT *, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY acted_utc DESC, interaction_id DESC) AS n FROM interactions WHERE type IN ('Bookmarked', 'Unbookmarked')) WHERE n = 1 AND type = 'Bookmarked'),
logged_queries AS (SELECT conv_id, turn, text AS query_text FROM conversations WHERE role = 'user')
"""


def sql(body: str) -> str:
    """A query over the views; one that begins WITH RECURSIVE may refer to itself."""
    if body.lstrip().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE" + sql("WITH " + body.lstrip().removeprefix("WITH RECURSIVE "))[4:]
    return f"WITH {SQL.strip()}{',' if body.lstrip().startswith('WITH ') else ''}\n{body.lstrip().removeprefix('WITH ')}"
