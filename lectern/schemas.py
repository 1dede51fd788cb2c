"""Schemas of the tables and of the JSON documents; readers pass them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LONG, INT, TEXT, REAL, FLAG, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
TEXTS = T.ArrayType(TEXT)

PAPER = _struct(paper_id=LONG, arxiv_id=TEXT, latest_version=INT, title=TEXT, abstract=TEXT, authors=TEXT, primary_category=TEXT, published_utc=TIME, updated_utc=TIME, abs_url=TEXT, pdf_url=TEXT, doi=TEXT, code_url=TEXT, first_ingested_utc=TIME, last_seen_utc=TIME)
CATEGORY = _struct(code=TEXT, name=TEXT)
PAPER_CATEGORY = _struct(paper_id=LONG, category=TEXT)
PAPER_EMBEDDING = _struct(paper_id=LONG, model_version=TEXT, vector=T.ArrayType(T.FloatType()), vector_int8=T.ArrayType(T.ByteType()), int8_scale=T.FloatType(), created_utc=TIME)
PAPER_SIGNAL = _struct(paper_id=LONG, citation_count=INT, influential_citation_count=INT, github_stars=INT, fetched_utc=TIME)
ANALYSIS_RESULT = _struct(user_id=LONG, paper_id=LONG, schema_version=INT, profile_version=INT, model=TEXT, result_json=TEXT, composite_score=T.DecimalType(5, 2), created_utc=TIME)
BOOKMARK = _struct(user_id=LONG, paper_id=LONG, created_utc=TIME)
SEARCH_EVENT = _struct(search_event_id=LONG, user_id=LONG, created_utc=TIME, query_text=TEXT, plan_json=TEXT, total_candidates=INT, result_limit=INT)
SEARCH_EVENT_RESULT = _struct(search_event_id=LONG, rank=INT, paper_id=LONG, score=REAL, is_wildcard=FLAG, proximity=TEXT, variant=TEXT)
INTERACTION_EVENT = _struct(interaction_id=LONG, user_id=LONG, created_utc=TIME, paper_id=LONG, type=TEXT, search_event_id=LONG, rank=INT)
BUDGET_GRANT = _struct(user_id=LONG, amount_micros=LONG, reason=TEXT, granted_by=TEXT, created_utc=TIME)
USAGE_EVENT = _struct(user_id=LONG, step=TEXT, model=TEXT, input_tokens=INT, output_tokens=INT, cost_micros=LONG, used_byo_key=FLAG, created_utc=TIME)
USER_PROFILE = _struct(user_id=LONG, experience_summary=TEXT, goals=TEXT, weekly_hours=INT, version=INT, updated_utc=TIME)
APP_USER = _struct(user_id=LONG, external_id=TEXT, email=TEXT, display_name=TEXT, role=TEXT, is_active=FLAG)
HIGH_WATER_MARK = _struct(category=TEXT, high_water_mark_utc=TIME, last_completed_run_utc=TIME)
INGESTION_RUN = _struct(run_id=TEXT, trigger=TEXT, status=TEXT, started_utc=TIME, completed_utc=TIME, fetched=LONG, added=LONG, updated=LONG, error=TEXT)

ENTRY = _struct(arxiv_id=TEXT, version=INT, title=TEXT, abstract=TEXT, authors=TEXTS, primary_category=TEXT, categories=TEXTS, published_utc=TIME, updated_utc=TIME, abs_url=TEXT, pdf_url=TEXT, doi=TEXT, code_url=TEXT)

PLAN = _struct(interpretation=TEXT, anchorText=TEXT, categories=TEXTS, dateWindowDays=INT, requireNoCode=FLAG, hypotheticalAbstract=TEXT, intent=TEXT)
VERDICTS = T.ArrayType(_struct(id=TEXT, grade=INT, rationale=TEXT))
EVAL_QUERIES = _struct(version=INT, queries=T.ArrayType(_struct(id=TEXT, persona=TEXT, query=TEXT, plan=PLAN, expectedCategories=TEXTS, acceptableCategories=TEXTS)))
JUDGMENTS = _struct(version=INT, rubricVersion=INT, judgments=T.ArrayType(_struct(queryId=TEXT, arxivId=TEXT, grade=INT, rationale=TEXT, judgeModel=TEXT, source=TEXT)))
CORPUS = _struct(arxivId=TEXT, latestVersion=INT, title=TEXT, abstract=TEXT, authors=TEXT, primaryCategory=TEXT, categories=TEXTS, publishedUtc=TEXT, updatedUtc=TEXT, absUrl=TEXT, pdfUrl=TEXT, doi=TEXT, codeUrl=TEXT)

#: The fields that a paper's analysis has to have.
ANALYSIS = _struct(summary=TEXT, feasibility_score=INT, hard_blockers=TEXTS, learning_bridge=TEXT, estimated_effort=TEXT, approach=TEXT, approach_rationale=TEXT, reference_code_likelihood=TEXT, goal_alignment_score=INT, resume_signal=TEXT, extension_idea=TEXT, required_skills=TEXTS, composite_score=REAL)
RUN_PART = _struct(run_id=TEXT, part=TEXT, fetched=LONG, added=LONG, updated=LONG, error=TEXT)
