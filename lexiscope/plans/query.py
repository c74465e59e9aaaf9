"""A named query and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# The article view of the documents table.
ARTICLES_SQL = """
articles AS (
  SELECT doc_id, source || '-' || doc_id AS title, string_split(text, chr(10))[1] AS summary,
         text AS body, lang AS category, source AS grp
  FROM documents
)"""


def bucket_sql(key: str) -> str:
    return f"(('0x' || substr(md5(coalesce('42:' || {key}, '42?')), 1, 8))::BIGINT % 100)"


def part_sql(key: str) -> str:
    bucket = bucket_sql(key)
    return f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 85 THEN 'validation' ELSE 'test' END"
