"""Inputs derived from the driver's tables: the same SQL runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_problems": "SELECT CAST(doc_id AS BIGINT) AS idx, 'src-' || CAST(doc_id AS STRING) AS source_id, doc_id, text AS problem_statement, lang, source AS title, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_examples FROM documents",
    "v_checkers": "SELECT 'src-' || CAST(doc_id AS STRING) AS id, doc_id, 'notes' || chr(10) || '</think>' || chr(10) || chr(10) || repeat('`', 3) || 'json' || chr(10) || '{\"type\":\"' || CASE WHEN quality = 1 THEN 'diff' ELSE 'checker' END || '\"}' || chr(10) || repeat('`', 3) || chr(10) AS generation FROM labels",
    "v_responses": "SELECT conv_id AS idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS sample_idx, text, CASE (conv_id + turn) % 5 WHEN 0 THEN 'intro' || chr(10) || repeat('`', 3) || 'py' || chr(10) || text || chr(10) || repeat('`', 3) || chr(10) || 'bye' WHEN 1 THEN repeat('`', 3) || 'py' || chr(10) || text WHEN 2 THEN text WHEN 3 THEN repeat('`', 3) || chr(10) || repeat('`', 3) || chr(10) || text ELSE repeat('`', 3) || chr(10) || 'first' || chr(10) || repeat('`', 3) || chr(10) || chr(10) || repeat('`', 3) || 'lua' || chr(10) || chr(10) || text || chr(10) || repeat('`', 3) END AS response FROM conversations WHERE role = 'assistant'",
    "v_results": "SELECT CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) AS item_id, user_id AS idx, event_id AS sample_idx, ts, value, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'fail:error' WHEN 'click' THEN 'fail:wrong-output' WHEN 'view' THEN 'fail:timeout' ELSE 'fail:no-answer' END AS status FROM events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = next(t for t in TABLES if f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {used}", "FROM {" + used + "}").replace('{"type":"', '{{"type":"').replace('"}\'', '"}}\''), **{used: table(spark, sf_dir, used)})


def with_views(sql: str) -> str:
    """The oracle's SQL with the views that it uses in front."""
    used = [f"{n} AS ({VIEWS[n].replace('AS STRING', 'AS VARCHAR')})" for n in VIEWS if n in sql]
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(used)}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
