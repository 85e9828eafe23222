"""Schemas of the store's tables and the defaults of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.columns import normalise_email

# Columns of the store's tables with their types, and the defaults of those that have one.
TABLES: dict[str, tuple[str, dict[str, object]]] = {
    "grading_records": (
        "id string, user_id string, status string, essay_text string, essay_topic string, input_type string, total_score int, grade string, word_count int, dimensions string, adjustments string, "
        "revisions string, suggestions string, raw_markdown string, raw_score int, adjusted_score int, grading_reason string, one_sentence_summary string, upgrade_path string, error_message string, "
        "is_guest int, created_at timestamp, updated_at timestamp",
        {
            "status": "done", "essay_text": "", "essay_topic": "", "input_type": "text", "total_score": 0, "grade": "", "word_count": 0, "dimensions": "{}", "adjustments": "{}", "revisions": "[]", "suggestions": "[]",
            "raw_markdown": "", "raw_score": 0, "adjusted_score": 0, "grading_reason": "", "one_sentence_summary": "", "upgrade_path": "{}", "is_guest": 0,
        },
    ),
    "users": (
        "id string, email string, password_hash string, nickname string, region string, role string, wechat_openid string, must_change_password int, grade string, school string, created_at timestamp, updated_at timestamp",
        {"region": "上海", "role": "user", "must_change_password": 0, "grade": "", "school": ""},
    ),
    "error_problems": (
        "id string, user_id string, subject string, topic string, question_text string, question_type string, answer_options string, wrong_answer string, correct_answer string, error_type string, "
        "correct_solution string, difficulty int, knowledge_explanation string, grading_evidence string, notes string, source string, ai_raw string, status string, session_id string, paper_index int, created_at timestamp, updated_at timestamp",
        {
            "subject": "数学", "topic": "", "question_type": "", "answer_options": "", "wrong_answer": "", "correct_answer": "", "error_type": "", "correct_solution": "", "difficulty": 3, "knowledge_explanation": "",
            "grading_evidence": "", "notes": "", "source": "", "ai_raw": "", "status": "done", "paper_index": 1,
        },
    ),
    "paper_sessions": (
        "id string, user_id string, subject string, title string, image_count int, status string, ai_raw string, error_count int, total_questions int, correct_count int, created_at timestamp, updated_at timestamp",
        {"title": "", "image_count": 1, "status": "pending", "ai_raw": "", "error_count": 0, "total_questions": 0, "correct_count": 0},
    ),
    "knowledge_points": ("id string, subject string, name string, parent_id string, category string", {"category": ""}),
    "error_knowledge_tags": ("error_id string, knowledge_id string", {}),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name][0])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def filled(df: DataFrame, name: str) -> DataFrame:
    """df as rows of a table: its columns and types, defaults where a value is missing; other columns of df are left out.

    A user's address is normalised, the nickname is its local part unless one is given; updated_at is created_at at first.
    """
    defaults = TABLES[name][1]
    have = {c: F.col(c) for c in df.columns}
    if name == "users" and "email" in have:
        have["email"] = normalise_email(F.col("email"))
        have["nickname"] = F.coalesce(F.nullif(have.get("nickname", F.lit("")), F.lit("")), F.get(F.split(have["email"], "@"), F.lit(0)))
    if "created_at" in have:
        have["updated_at"] = F.coalesce(have.get("updated_at", F.lit(None)), F.col("created_at"))
    value = lambda f: F.coalesce(have.get(f.name, F.lit(None)), F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
    return df.select(*[value(f) for f in schema(name)])
