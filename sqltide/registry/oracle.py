"""Shared pieces of the oracle SQL: the derived tables and the rules in ANSI SQL."""

from __future__ import annotations

from sqltide import fixtures
from sqltide.fixtures import AS_OF


def normalized(column: str) -> str:
    """The normaliser's steps for an engine with linear-time patterns."""
    text = f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"
    for pattern, replacement, flags in (
        (r"''(?:[^''\\]|\\.)*''", "?", "g"),
        (r'"(?:[^"\\\\]|\\\\.)*"', "?", "g"),
        (r"\b-?\d+\.?\d*\b", "?", "g"),
        (r"\b0x[0-9a-fA-F]+\b", "?", "g"),
        (r"\(\s*\?\s*(?:,\s*\?\s*)+\)", "(?)", "g"),
        (r"\bLIMIT\s+\?(?:\s+OFFSET\s+\?)?", "LIMIT ?", "gi"),
        (r"\bOFFSET\s+\?", "OFFSET ?", "gi"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', '{flags}')"
    return f"rtrim({text}, ';')"


def tables_of(column: str) -> str:
    low = f"lower({column})"
    names = r"\s+([a-zA-Z_][a-zA-Z0-9_]*)"
    found = (
        f"list_concat(regexp_extract_all({low}, '\\bfrom{names}', 1), "
        f"regexp_extract_all({low}, '\\bjoin{names}', 1))"
    )
    # distinct, in order of first appearance
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def level_rank(column: str) -> str:
    return (
        f"(CASE {column} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 "
        f"WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END)"
    )


LEVEL_OF = "CASE {0} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END"

_FEATURES = """
SELECT *,
  CASE WHEN plan_json IS NULL OR trim(plan_json) IN ('', '{}') THEN 'heuristic'
       WHEN source_db_type IN ('mysql', 'postgres') THEN source_db_type ELSE 'other' END AS rule_branch,
  json_extract_string(plan_json, '$.query_block.table.access_type') AS m_access,
  coalesce(json_extract_string(plan_json, '$.query_block.table.table_name'), 'unknown') AS m_table,
  CAST(json_extract_string(plan_json, '$.query_block.table.rows_examined_per_scan') AS bigint) AS m_rows,
  coalesce(contains(lower(CAST(json_extract(plan_json, '$.query_block') AS varchar)), 'filesort'), false) AS m_sort,
  json_extract_string(plan_json, '$.Plan."Node Type"') AS p_node,
  coalesce(json_extract_string(plan_json, '$.Plan."Relation Name"'), 'unknown') AS p_table,
  CAST(json_extract_string(plan_json, '$.Plan."Total Cost"') AS double) AS p_cost,
  CASE WHEN rows_examined > 0
    THEN CAST(rows_examined AS double) / greatest(coalesce(rows_returned, 1), 1) END AS ratio
FROM q"""

_FINDINGS = """
SELECT id AS slow_query_id, rule_branch,
  (rule_branch = 'heuristic' AND coalesce(ratio > 10, false) AND rows_returned IS NULL) AS analysis_failed,
  CASE
    WHEN rule_branch = 'mysql' AND m_access IN ('ALL', 'index') THEN 'Full table scan detected'
    WHEN rule_branch = 'postgres' AND p_node = 'Seq Scan' THEN 'Sequential scan detected'
    WHEN rule_branch = 'heuristic' AND ratio > 100 THEN 'Inefficient query: examining too many rows'
    WHEN rule_branch = 'heuristic' AND ratio > 10 THEN 'Moderate inefficiency in row scanning'
    ELSE 'Slow query detected' END AS problem,
  CASE
    WHEN rule_branch = 'mysql' AND m_rows > 100000 THEN
      'Query examines ' || format('{:,}', m_rows) || ' rows. This indicates missing or ineffective indexes.'
    WHEN rule_branch = 'mysql' AND m_access IN ('ALL', 'index') THEN
      'Query is performing a full table scan (access_type: ' || m_access || '). This means every row in the table is being examined, which is very slow for large tables.'
    WHEN rule_branch = 'postgres' AND p_cost > 10000 THEN
      'Query has high execution cost estimate (' || printf('%.2f', p_cost) || '). This usually indicates inefficient query structure or missing indexes.'
    WHEN rule_branch = 'postgres' AND p_node = 'Seq Scan' THEN
      'Query is performing a sequential scan on ' || p_table || '. PostgreSQL is reading every row in the table sequentially, which is slow for large tables.'
    WHEN rule_branch = 'heuristic' AND ratio > 100 THEN
      'Query examines ' || format('{:,}', rows_examined) || ' rows but returns only ' || format('{:,}', rows_returned) || ' rows (ratio: ' || printf('%.1f', ratio) || ':1). This suggests missing or ineffective indexes.'
    WHEN rule_branch = 'heuristic' AND ratio > 10 THEN
      'Query examines ' || format('{:,}', rows_examined) || ' rows to return ' || format('{:,}', rows_returned) || ' rows. Consider adding indexes to narrow down the scan.'
    ELSE 'Query execution time exceeds threshold' END AS root_cause,
  list_filter([
    'REVIEW|MEDIUM|Review query and add appropriate indexes|-- Analyze query patterns and optimize|Varies',
    CASE WHEN rule_branch = 'mysql' AND m_access IN ('ALL', 'index') THEN
      'INDEX|HIGH|Add index to ' || m_table || ' to avoid full table scan|-- Analyze query and add appropriate index on ' || m_table || '|10-100x improvement' END,
    CASE WHEN rule_branch = 'mysql' AND m_sort THEN
      'INDEX|MEDIUM|Add index to avoid filesort operation|-- Add index on ORDER BY columns|2-5x improvement' END,
    CASE WHEN rule_branch = 'postgres' AND p_node = 'Seq Scan' THEN
      'INDEX|HIGH|Add index to ' || p_table || ' to enable index scan|-- CREATE INDEX idx_' || p_table || '_cols ON ' || p_table || '(column_name);|10-100x improvement' END,
    CASE WHEN rule_branch = 'postgres' AND p_cost > 10000 THEN
      'OPTIMIZATION|MEDIUM|Review query structure and consider query rewrite|-- Consider breaking down complex query or adding indexes|2-10x improvement' END,
    CASE WHEN rule_branch = 'heuristic' AND ratio > 100 THEN
      'INDEX|HIGH|Add indexes to reduce rows examined|-- Analyze WHERE clauses and add appropriate indexes|10-50x improvement' END,
    CASE WHEN rule_branch = 'heuristic' AND ratio > 10 AND ratio <= 100 THEN
      'INDEX|MEDIUM|Consider adding indexes to improve filtering|-- Review WHERE clauses and add selective indexes|2-10x improvement' END,
    CASE WHEN rule_branch = 'heuristic' AND duration_ms > 5000 THEN
      'REVIEW|HIGH|Query takes more than 5 seconds - requires urgent optimization|-- Consider query rewrite, partitioning, or caching|Critical performance issue' END
  ], lambda s: s IS NOT NULL) AS items,
  CASE
    WHEN rule_branch = 'mysql' AND m_access IN ('ALL', 'index') THEN 'HIGH'
    WHEN rule_branch = 'mysql' AND (m_sort OR m_rows > 100000) THEN 'MEDIUM'
    WHEN rule_branch = 'postgres' AND p_node = 'Seq Scan' THEN 'HIGH'
    WHEN rule_branch = 'postgres' AND p_cost > 10000 THEN 'MEDIUM'
    WHEN rule_branch = 'heuristic' AND ratio > 100 THEN 'HIGH'
    WHEN rule_branch = 'heuristic' AND (ratio > 10 OR duration_ms > 5000) THEN 'MEDIUM'
    ELSE 'LOW' END AS improvement_level,
  CASE
    WHEN (rule_branch = 'mysql' AND m_access IN ('ALL', 'index'))
      OR (rule_branch = 'postgres' AND p_node = 'Seq Scan') THEN '10-100x'
    WHEN rule_branch = 'heuristic' AND ratio > 100 THEN '10-50x'
    WHEN rule_branch = 'heuristic' AND ratio > 10 THEN '2-10x'
    ELSE '2-5x' END AS estimated_speedup,
  CASE
    WHEN (rule_branch = 'mysql' AND m_access IN ('ALL', 'index'))
      OR (rule_branch = 'postgres' AND p_node = 'Seq Scan') THEN 0.9
    WHEN rule_branch = 'heuristic' AND ratio > 100 THEN 0.8
    ELSE 0.7 END::double AS confidence,
  source_db_type, full_sql, status
FROM feat"""

# Analyses of the ANALYZED queries; effectiveness starts as PENDING.
_ANALYSES = """
SELECT md5(slow_query_id || '|1.0.0') AS id, slow_query_id, problem, root_cause, items,
  improvement_level, estimated_speedup, confidence, 'PENDING' AS effectiveness
FROM findings WHERE status = 'ANALYZED' AND NOT analysis_failed"""

_EVALUATED = """
SELECT a.*, q.fingerprint, q.source_db_type, q.captured_at AS old_time,
  CAST(q.duration_ms AS double) AS old_duration_ms, n.new_duration_ms,
  (CAST(q.duration_ms AS double) - n.new_duration_ms) / CAST(q.duration_ms AS double) AS gain_ratio,
  CASE WHEN n.new_duration_ms IS NULL THEN 'PENDING'
       WHEN (CAST(q.duration_ms AS double) - n.new_duration_ms) / CAST(q.duration_ms AS double) < 0 THEN 'FAILED'
       WHEN (CAST(q.duration_ms AS double) - n.new_duration_ms) / CAST(q.duration_ms AS double) < 0.3 THEN 'PENDING'
       ELSE 'CONFIRMED' END AS state
FROM a JOIN q ON q.id = a.slow_query_id
LEFT JOIN (SELECT id, CAST(sum(duration_ms) AS double) / count(*) AS new_duration_ms
           FROM after_rows GROUP BY id) n ON n.id = a.id"""

# By definition: later executions of the pattern, then the newest five of them.
_AFTER = """
SELECT id, execution_id, captured_at, duration_ms FROM (
  SELECT a.id, p.id AS execution_id, p.captured_at, p.duration_ms,
    row_number() OVER (PARTITION BY a.id ORDER BY p.captured_at DESC, p.id DESC) AS nth
  FROM a JOIN q o ON o.id = a.slow_query_id
  JOIN q p ON p.fingerprint = o.fingerprint AND p.captured_at > o.captured_at + INTERVAL 10 MINUTE
    AND p.duration_ms IS NOT NULL) x
WHERE nth <= 5"""

_FEEDBACK = f"""
SELECT md5(e.id || '|{AS_OF}') AS id, fingerprint AS slow_query_fingerprint, e.id AS analysis_result_id,
  old_duration_ms, new_duration_ms, gain_ratio, TIMESTAMP '{AS_OF}' AS checked_at
FROM evaluated e WHERE new_duration_ms IS NOT NULL"""

SUMMARY_COLUMNS = """fingerprint, source_db_type, source_db_host, id, execution_count,
  round(avg_duration_ms, 6) AS avg_duration_ms, min_duration_ms, max_duration_ms,
  round(p95_duration_ms, 6) AS p95_duration_ms, total_duration_ms, last_seen, has_analysis, max_improvement_level"""

_SUMMARY = f"""
SELECT fingerprint, source_db_type, source_db_host, max_by(q.id, (captured_at, q.id)) AS id,
  count(*) AS execution_count, CAST(sum(duration_ms) AS double) / count(duration_ms) AS avg_duration_ms,
  CAST(min(duration_ms) AS double) AS min_duration_ms, CAST(max(duration_ms) AS double) AS max_duration_ms,
  quantile_cont(CAST(duration_ms AS double), 0.95) AS p95_duration_ms,
  CAST(sum(duration_ms) AS double) AS total_duration_ms,
  max(captured_at) AS last_seen, bool_or(status = 'ANALYZED') AS has_analysis,
  {LEVEL_OF.format('max(' + level_rank('improvement_level') + ')')} AS max_improvement_level
FROM q LEFT JOIN a ON a.slow_query_id = q.id
GROUP BY fingerprint, source_db_type, source_db_host"""

_TABLES = f"""
SELECT source_db_type, source_db_host, table_name, count(*) AS query_count,
  CAST(sum(duration_ms) AS double) / count(*) AS avg_duration_ms,
  count(DISTINCT fingerprint) AS distinct_queries
FROM (SELECT *, unnest({tables_of('full_sql')}) AS table_name FROM q) t
GROUP BY source_db_type, source_db_host, table_name"""

_MARKED = r"""
SELECT *, regexp_extract(full_sql, '/\*\s*TEST:([A-Za-z]+)-([0-9]+):([^*]*?)\s*\*/', 1) AS category,
  regexp_extract(full_sql, '/\*\s*TEST:([A-Za-z]+-[0-9]+):([^*]*?)\s*\*/', 1) AS case_id,
  regexp_extract(full_sql, '/\*\s*TEST:([A-Za-z]+)-([0-9]+):([^*]*?)\s*\*/', 3) AS case_name
FROM q WHERE regexp_matches(full_sql, '/\*\s*TEST:([A-Za-z]+)-([0-9]+):([^*]*?)\s*\*/')"""

_SOURCE = "source_db_type, source_db_host, source_db_name"

# name: (tables it needs, SELECT)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "q0": ((), fixtures.slow_query_sql()),
    "q": (
        ("q0",),
        f"SELECT *, CASE WHEN fingerprint = '' THEN '' ELSE md5(fingerprint) END AS sql_hash "
        f"FROM (SELECT *, {normalized('full_sql')} AS fingerprint FROM q0) f",
    ),
    "mysql_log": (("q0",), fixtures.mysql_log_sql()),
    "pg_stat": (("q0",), fixtures.pg_stat_sql()),
    "statements": ((), fixtures.statements_sql()),
    "nested_plans": ((), fixtures.nested_plan_sql()),
    "metadata": (("q0",), fixtures.metadata_sql()),
    "replies": (("q0",), fixtures.replies_sql()),
    "cases": ((), fixtures.cases_sql()),
    "new_patterns": ((), fixtures.new_patterns_sql()),
    "users": ((), fixtures.USERS_SQL.format(customer="customer")),
    "lab_orders": ((), fixtures.LAB_ORDERS_SQL.format(orders="orders")),
    "feat": (("q",), _FEATURES),
    "findings": (("feat",), _FINDINGS),
    "a": (("findings",), _ANALYSES),
    "after_rows": (("a", "q"), _AFTER),
    "evaluated": (("a", "q", "after_rows"), _EVALUATED),
    "feedback": (("evaluated",), _FEEDBACK),
    "summary": (("q", "a"), _SUMMARY),
    "impactful": (("q",), _TABLES),
    "marked": (("q",), _MARKED),
    "latest_meta": (
        ("metadata",),
        f"SELECT m.* FROM metadata m JOIN (SELECT {_SOURCE}, max(captured_at) AS captured_at "
        f"FROM metadata GROUP BY {_SOURCE}) l USING ({_SOURCE}, captured_at)",
    ),
    "meta_tables": (
        ("latest_meta",),
        f"SELECT {_SOURCE}, captured_at, 'orders' AS table_name, orders_rows AS row_count, "
        f"'orders_pk' AS indexes FROM latest_meta UNION ALL "
        f"SELECT {_SOURCE}, captured_at, 'users', users_rows, 'idx_email,users_pk' FROM latest_meta",
    ),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the derived tables it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][1].strip()})" for name in ordered)
    return f"WITH {parts}\n{body.strip()}"
