"""Where queries are registered, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Lines of documents with deterministic additions, so that rules fire that never do on the raw texts. Read by both engines.
ENRICHED = """CASE WHEN line_no % 7 = 6 THEN 'Sure, here is ' || line WHEN line_no % 11 = 0 THEN 'Chapter ' || CAST(doc_id % 9 + 1 AS STRING) || ' ' || line
 WHEN line_no % 10 IN (3, 4) THEN '| ' || CAST(doc_id AS STRING) || ' | ' || CAST(line_no AS STRING) || ' |' WHEN line_no % 13 = 5 THEN '12.'
 WHEN line_no % 17 = 9 THEN '- ' || line WHEN line_no % 19 = 8 THEN '3. ' || line WHEN line_no % 23 = 12 THEN 'Assistant: ' || line ELSE line END"""

LINES_SQL = "lines AS (SELECT doc_id, lang, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
ENRICHED_SQL = f"{LINES_SQL}, enriched AS (SELECT doc_id, lang, source, line_no, {ENRICHED} AS line FROM lines)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docforge.operators.sequence import lines_of
    from docforge.sources.tables import spread, table

    return lines_of(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))).withColumn("line_no", F.col("line_no").cast("bigint"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return lines(spark, sf_dir).withColumn("line", F.expr(ENRICHED))
