"""Analysis rules, model replies, results and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.fixtures import AS_OF, Tables
from sqltide.plans import analysis, replies, rules
from sqltide.registry.base import Entry, analyses, items_text
from sqltide.registry.oracle import sql

_COLUMNS = (
    "problem, root_cause, array_to_string(items, ';') AS suggestions, improvement_level, "
    "estimated_speedup, confidence"
)


def _finding_columns(df: DataFrame, key: str = "slow_query_id") -> DataFrame:
    return df.select(
        key, "problem", "root_cause", items_text().alias("suggestions"), "improvement_level",
        "estimated_speedup", F.col("confidence").cast("double").alias("confidence"),
    )


def _branch(name: str):
    def run(t: Tables) -> DataFrame:
        found = rules.dispatch_rules(t.queries()).where(
            (F.col("rule_branch") == name) & ~F.col("analysis_failed")
        )
        return _finding_columns(found.withColumnRenamed("id", "slow_query_id"))

    return Entry(
        run,
        sql(
            f"SELECT slow_query_id, {_COLUMNS} FROM findings "
            f"WHERE rule_branch = '{name}' AND NOT analysis_failed",
            "findings",
        ),
    )


def _defaults(t: Tables) -> DataFrame:
    columns = [value.alias(name) for name, value in rules.default_analysis().items()]
    return _finding_columns(t.queries().select(F.col("id").alias("slow_query_id"), *columns))


def _dispatched(t: Tables) -> DataFrame:
    found = rules.dispatch_rules(t.queries())
    return found.select(
        F.col("id").alias("slow_query_id"), "rule_branch", "analysis_failed", "improvement_level",
        F.array_join("tables", ",").alias("tables"),
    )


def _parsed(t: Tables) -> DataFrame:
    parsed = replies.parse_ai_replies(t.replies())
    return parsed.select(
        "slow_query_id", "root_cause", "problem", items_text().alias("suggestions"),
        "improvement_level", "estimated_speedup", F.array_join("ai_insights", ";").alias("insights"),
        F.size("additional_suggestions").alias("additional"), "confidence", "provider", "model",
    )


_STUB_INSIGHTS = (
    "This query could benefit from proper indexing;Consider analyzing the WHERE clause conditions;"
    "Review if all columns in SELECT are necessary"
)
_PARSED_SQL = f"""
SELECT slow_query_id,
  CASE kind WHEN 'full' THEN json_extract_string(reply, '$.root_cause') WHEN 'bare' THEN '' END AS root_cause,
  CASE kind WHEN 'full' THEN 'problem' WHEN 'bare' THEN '' END AS problem,
  CASE kind WHEN 'full' THEN 'INDEX|HIGH|filter|CREATE INDEX i ON orders(user_id)|10x;OPTIMIZATION|MEDIUM|no star|SELECT id|Varies' ELSE '' END AS suggestions,
  CASE kind WHEN 'full' THEN 'CRITICAL' WHEN 'bare' THEN 'MEDIUM' END AS improvement_level,
  CASE kind WHEN 'full' THEN '50x' WHEN 'bare' THEN '2-5x' END AS estimated_speedup,
  CASE kind WHEN 'text' THEN reply WHEN 'list' THEN '{_STUB_INSIGHTS}' ELSE '' END AS insights,
  CASE kind WHEN 'list' THEN 2 ELSE 0 END AS additional,
  CASE kind WHEN 'full' THEN CAST(json_extract_string(reply, '$.confidence') AS double)
    WHEN 'bare' THEN 0.85 ELSE 0.75 END::double AS confidence,
  CASE kind WHEN 'list' THEN 'stub' ELSE 'openai' END AS provider,
  CASE kind WHEN 'list' THEN 'mock-v1' ELSE 'gpt-4' END AS model
FROM (SELECT *, CASE WHEN NOT json_valid(reply) THEN 'text' WHEN json_type(reply) = 'ARRAY' THEN 'list'
        WHEN json_exists(reply, '$.root_cause') THEN 'full' ELSE 'bare' END AS kind
      FROM replies WHERE reply IS NOT NULL) r"""


def _merged(t: Tables) -> DataFrame:
    parsed = replies.parse_ai_replies(t.replies())
    merged = replies.merge_ai(analysis.rule_findings(t.queries()), parsed)
    return merged.select(
        "slow_query_id", "problem", "root_cause", items_text().alias("suggestions"),
        "improvement_level", "estimated_speedup", F.col("confidence").cast("double").alias("confidence"),
        "method", F.col("metadata.ai_provider").alias("provider"),
        F.array_join("metadata.tables", ",").alias("tables"),
    )


_STUB_ITEMS = (
    "BEST_PRACTICE|LOW|Use specific column names instead of SELECT *;"
    "MONITORING|LOW|Set up query performance monitoring"
)
MERGED_SQL = f"""
SELECT f.slow_query_id,
  coalesce(nullif(r.problem, ''), f.problem) AS problem,
  coalesce(nullif(r.root_cause, ''), f.root_cause) AS root_cause,
  CASE WHEN r.suggestions <> '' THEN r.suggestions
       WHEN r.additional > 0 THEN array_to_string(items, ';') || ';{_STUB_ITEMS}'
       ELSE array_to_string(items, ';') END AS suggestions,
  coalesce(r.improvement_level, f.improvement_level) AS improvement_level,
  coalesce(r.estimated_speedup, f.estimated_speedup) AS estimated_speedup,
  CASE WHEN r.confidence < 9.995 THEN r.confidence ELSE f.confidence END AS confidence,
  CASE WHEN r.root_cause <> '' THEN 'ai_assisted' WHEN r.confidence IS NOT NULL THEN 'hybrid'
       ELSE 'rule_based' END AS method,
  r.provider,
  CASE WHEN contains(full_sql, 'JOIN') THEN 'users,orders' WHEN contains(full_sql, 'FROM orders') THEN 'orders'
       WHEN contains(full_sql, 'FROM users') THEN 'users' ELSE '' END AS tables
FROM findings f LEFT JOIN ({_PARSED_SQL}) r ON r.slow_query_id = f.slow_query_id
WHERE NOT analysis_failed"""


def _pending_results(t: Tables) -> DataFrame:
    results = analysis.analyze_pending(t.queries(), analyses(t), AS_OF)
    return results.select(
        "id", "slow_query_id", "problem", "root_cause", items_text().alias("suggestions"),
        "improvement_level", "estimated_speedup", "analyzer_version", "analysis_method",
        F.col("confidence_score").cast("double").alias("confidence"),
        "analyzed_at", "gain_ratio", "effectiveness",
    )


def _answered_results(t: Tables) -> DataFrame:
    """Pending queries analysed with the model's replies."""
    parsed = replies.parse_ai_replies(t.replies())
    return answered_columns(analysis.analyze_pending(t.queries(), analyses(t), AS_OF, replies=parsed))


def answered_columns(results: DataFrame) -> DataFrame:
    return results.select(
        "slow_query_id", "problem", "root_cause", items_text().alias("suggestions"), "improvement_level",
        "estimated_speedup", F.col("confidence_score").cast("double").alias("confidence"),
        F.col("analysis_method").alias("method"), F.col("analysis_metadata.ai_provider").alias("provider"),
        F.array_join("analysis_metadata.tables", ",").alias("tables"),
    )


def _statuses(t: Tables) -> DataFrame:
    q = t.queries()
    results = analysis.analyze_pending(q, analyses(t), AS_OF)
    return analysis.apply_status(q, results, analyses(t)).select("id", "status")


_NODES_SQL = """
SELECT p.id AS slow_query_id, source_db_type,
  coalesce(json_extract_string(n.value, '$.access_type'), json_extract_string(n.value, '$."Node Type"')) AS node_type,
  coalesce(json_extract_string(n.value, '$.table_name'), json_extract_string(n.value, '$."Relation Name"')) AS table_name,
  CAST(coalesce(json_extract_string(n.value, '$.rows_examined_per_scan'), json_extract_string(n.value, '$."Plan Rows"')) AS bigint) AS node_rows,
  json_extract_string(n.value, '$.using_filesort') AS sorts
FROM nested_plans p, json_tree(p.plan_json) n WHERE n.type = 'OBJECT'"""


def _nested(t: Tables) -> DataFrame:
    """Findings of queries whose plans hold joins, sorts and nested loops."""
    count = F.lit(None).cast("bigint")
    q = t.nested_plans().withColumns(
        {"rows_examined": count, "rows_returned": count, "duration_ms": F.lit(None).cast("decimal(18,3)"),
         "full_sql": F.lit("SELECT 1")}
    )
    return _finding_columns(rules.dispatch_rules(q).withColumnRenamed("id", "slow_query_id"))


# A full scan counts from 100,001 rows on; MySQL's root rule tells of the file sort.
_NESTED_SQL = """
SELECT concat('p-', o_orderkey) AS slow_query_id,
  CASE WHEN big THEN 'Full table scan inside a join' ELSE 'Slow query detected' END AS problem,
  CASE WHEN big THEN concat('The plan reads all of ', scanned, ' (', format('{:,}', n), ' rows, ', kind, ') below its root.')
    ELSE 'Query execution time exceeds threshold' END AS root_cause,
  array_to_string(list_filter([
    'REVIEW|MEDIUM|Review query and add appropriate indexes|-- Analyze query patterns and optimize|Varies',
    CASE WHEN mysql THEN 'INDEX|MEDIUM|Add index to avoid filesort operation|-- Add index on ORDER BY columns|2-5x improvement' END,
    CASE WHEN big THEN concat('INDEX|HIGH|Add index to ', scanned, ' on the columns of its filter|-- CREATE INDEX ON ', scanned,
      ' (filter columns)|10-100x improvement') END,
    CASE WHEN big THEN 'INDEX|HIGH|Add indexes on the join columns of the nested loop|' ||
      '-- Add index on the inner table''s join column|5-50x improvement' END,
    CASE WHEN NOT mysql THEN 'INDEX|MEDIUM|Add index on the sort columns to avoid a sort or temporary table|' ||
      '-- Add index on ORDER BY or GROUP BY columns|2-5x improvement' END
  ], lambda s: s IS NOT NULL), ';') AS suggestions,
  CASE WHEN big THEN 'HIGH' ELSE 'MEDIUM' END AS improvement_level,
  CASE WHEN big THEN '10-100x' ELSE '2-5x' END AS estimated_speedup,
  CAST(CASE WHEN big THEN 0.85 ELSE 0.7 END AS double) AS confidence
FROM (SELECT o_orderkey, o_custkey * 977 AS n, o_custkey * 977 > 100000 AS big, o_orderstatus = 'F' AS mysql,
    CASE o_orderstatus WHEN 'F' THEN 'o' ELSE 'orders' END AS scanned,
    CASE o_orderstatus WHEN 'F' THEN 'ALL' ELSE 'Seq Scan' END AS kind FROM orders) x"""

ENTRIES: dict[str, Entry] = {
    "dispatch_nested_plans": Entry(_nested, _NESTED_SQL.strip()),
    "default_analysis": Entry(
        _defaults,
        sql(
            "SELECT id AS slow_query_id, 'Slow query detected' AS problem, "
            "'Query execution time exceeds threshold' AS root_cause, "
            "'REVIEW|MEDIUM|Review query and add appropriate indexes|-- Analyze query patterns and optimize|Varies' "
            "AS suggestions, 'LOW' AS improvement_level, '2-5x' AS estimated_speedup, "
            "CAST(0.7 AS double) AS confidence FROM q",
            "q",
        ),
    ),
    "mysql_plan_rules": _branch("mysql"),
    "postgres_plan_rules": _branch("postgres"),
    "heuristic_rules": _branch("heuristic"),
    "dispatch_rules": Entry(
        _dispatched,
        sql(
            "SELECT slow_query_id, rule_branch, analysis_failed, improvement_level, "
            "CASE WHEN contains(full_sql, 'JOIN') THEN 'users,orders' "
            "WHEN contains(full_sql, 'FROM orders') THEN 'orders' "
            "WHEN contains(full_sql, 'FROM users') THEN 'users' ELSE '' END AS tables FROM findings",
            "findings",
        ),
    ),
    "parse_ai_replies": Entry(_parsed, sql(_PARSED_SQL, "replies")),
    "merge_ai": Entry(_merged, sql(MERGED_SQL, "findings", "replies")),
    "analyze_pending": Entry(
        _pending_results,
        sql(
            "SELECT md5(slow_query_id || '|1.0.0') AS id, slow_query_id, problem, root_cause, "
            "array_to_string(items, ';') AS suggestions, improvement_level, estimated_speedup, "
            "'1.0.0' AS analyzer_version, 'rule_based' AS analysis_method, confidence, "
            f"TIMESTAMP '{AS_OF}' AS analyzed_at, CAST(NULL AS double) AS gain_ratio, "
            "'PENDING' AS effectiveness FROM findings WHERE status = 'NEW' AND NOT analysis_failed",
            "findings",
        ),
    ),
    "analyze_pending_with_replies": Entry(
        _answered_results,
        sql(f"{MERGED_SQL} AND status = 'NEW'", "findings", "replies"),
    ),
    "apply_status": Entry(
        _statuses,
        sql(
            "SELECT slow_query_id AS id, CASE WHEN status <> 'NEW' THEN status "
            "WHEN analysis_failed THEN 'ERROR' ELSE 'ANALYZED' END AS status FROM findings",
            "findings",
        ),
    ),
    "plan_nodes": Entry(
        lambda t: rules.plan_nodes(t.nested_plans()).drop("node_no"),
        sql(
            "SELECT slow_query_id, source_db_type, node_type, table_name, node_rows, "
            "CASE WHEN node_type IN ('ALL', 'index', 'Seq Scan') AND node_rows > 100000 THEN 'FULL_SCAN' "
            "WHEN node_type = 'Nested Loop' AND node_rows > 100000 THEN 'LARGE_NESTED_LOOP' "
            "WHEN sorts = 'true' OR node_type = 'Sort' THEN 'SORT_OR_TEMPORARY' END AS finding "
            f"FROM ({_NODES_SQL}) n WHERE node_type IS NOT NULL OR sorts = 'true'",
            "nested_plans",
        ),
    ),
    "explode_suggestions": Entry(
        lambda t: analysis.explode_suggestions(analyses(t)).drop("rationale"),
        sql(
            "SELECT id AS analysis_id, slow_query_id, CAST(position AS integer) AS position, "
            "split_part(item, '|', 1) AS type, split_part(item, '|', 2) AS priority, "
            "split_part(item, '|', 3) AS description, split_part(item, '|', 4) AS sql, "
            "split_part(item, '|', 5) AS estimated_impact FROM "
            "(SELECT id, slow_query_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS position FROM a) e",
            "a",
        ),
    ),
}
