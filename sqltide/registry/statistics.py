"""Joins, aggregates and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.fixtures import AS_OF, Tables
from sqltide.operators import daily, joins, learning, ranking, stats
from sqltide.registry.base import Entry, analyses, evaluated, feedback, rounded
from sqltide.registry.oracle import SUMMARY_COLUMNS, sql
from sqltide.sources import store
from sqltide.sources.store import latest_db_metadata

_PATTERN = "fingerprint, source_db_type, source_db_host"


def summary(t: Tables, **filters) -> DataFrame:
    return stats.pattern_summary(t.queries(), analyses(t), **filters)


def shown(df: DataFrame) -> DataFrame:
    return rounded(df, "avg_duration_ms", "p95_duration_ms")


def _joined(df: DataFrame) -> DataFrame:
    return df.select("id", "fingerprint", "status", "problem", "improvement_level")


def _context(t: Tables) -> DataFrame:
    # The users tables of one database are unknown.
    latest = latest_db_metadata(t.metadata()).where("source_db_name <> 'db1' OR table_name <> 'users'")
    context = joins.schema_context(t.queries(), latest)
    entry = F.transform(
        "schema_context",
        lambda e: F.concat_ws(
            ":", e["table_name"], F.coalesce(e["row_count"].cast("string"), F.lit("?")),
            F.coalesce(F.array_join(e["indexes"], ","), F.lit("?")),
        ),
    )
    return context.select("id", F.array_join(entry, ";").alias("context"))


_CONTEXT_SQL = """
SELECT q.id, coalesce(string_agg(u.table_name || ':' || coalesce(CAST(row_count AS varchar), '?') || ':' ||
  coalesce(indexes, '?'), ';' ORDER BY u.table_name), '') AS context
FROM q LEFT JOIN (SELECT id, source_db_type, source_db_host, source_db_name,
        unnest(CASE WHEN contains(full_sql, 'JOIN') THEN ['users', 'orders']
                    WHEN contains(full_sql, 'FROM orders') THEN ['orders']
                    WHEN contains(full_sql, 'FROM users') THEN ['users'] ELSE [] END) AS table_name FROM q) u
  ON u.id = q.id
LEFT JOIN (SELECT * FROM meta_tables WHERE source_db_name <> 'db1' OR table_name <> 'users') m
  ON (m.source_db_type, m.source_db_host, m.source_db_name, m.table_name) =
     (u.source_db_type, u.source_db_host, u.source_db_name, u.table_name)
GROUP BY q.id"""


def _global(t: Tables) -> DataFrame:
    """The nested row, each part as text with all its fields."""
    row = stats.global_stats(t.queries(), analyses(t), AS_OF)

    def text(name: str, *fields: str) -> Column:
        said = lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])
        return F.array_join(F.transform(name, said), ";").alias(name)

    def whole(name: str) -> Column:
        # Durations in whole microseconds, which both engines print alike.
        return F.transform(name, lambda x: x.withField("avg", F.round(x["avg_duration_ms"] * 1e3).cast("bigint")))

    row = row.withColumns({c: whole(c) for c in ("top_tables", "recent_trend")})
    row = row.withColumn(
        "recent_trend",
        F.transform("recent_trend", lambda x: x.withField("most", F.round(x["max_duration_ms"] * 1e3).cast("bigint"))),
    )
    return row.select(
        "total_slow_queries", "total_analyzed", "total_pending", "databases_monitored",
        text("top_tables", "source_db_type", "source_db_host", "table_name", "query_count", "avg", "distinct_queries"),
        text("improvement_summary", "improvement_level", "count"),
        text("recent_trend", "date", "query_count", "avg", "most"),
    )


_GLOBAL_SQL = f"""
SELECT (SELECT count(*) FROM q) AS total_slow_queries,
  (SELECT count(*) FROM q WHERE status = 'ANALYZED') AS total_analyzed,
  (SELECT count(*) FROM q WHERE status = 'NEW') AS total_pending,
  (SELECT count(DISTINCT source_db_host) FROM q) AS databases_monitored,
  (SELECT string_agg(concat_ws('|', source_db_type, source_db_host, table_name, query_count,
       CAST(round(avg_duration_ms * 1000) AS bigint), distinct_queries), ';'
     ORDER BY query_count DESC, source_db_type, source_db_host, table_name)
   FROM (SELECT * FROM impactful ORDER BY query_count DESC, source_db_type, source_db_host, table_name LIMIT 5) i) AS top_tables,
  (SELECT string_agg(improvement_level || '|' || n, ';' ORDER BY improvement_level)
   FROM (SELECT improvement_level, count(*) AS n FROM a GROUP BY improvement_level) l) AS improvement_summary,
  (SELECT string_agg(concat_ws('|', d, n, CAST(round(mean * 1000) AS bigint), CAST(most * 1000 AS bigint)), ';' ORDER BY d) FROM (
     SELECT CAST(captured_at AS date) AS d, count(*) AS n, CAST(sum(duration_ms) AS double) / count(*) AS mean,
       max(duration_ms) AS most FROM q
     WHERE captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1) t) AS recent_trend"""


def _days(t: Tables) -> DataFrame:
    """Three batches, the second of them twice, kept by day."""
    path = store.new_folder(t.spark, "days")
    q = t.queries()
    for batch in (0, 1, 1, 2):
        daily.add_days(q.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch), batch, path)
    return daily.read_days(t.spark, path)


def _summary_of_days(t: Tables) -> DataFrame:
    """The sketch's percentile is compared by its rank among the pattern's durations."""
    found = store.durable(daily.summary_of_days(_days(t)))
    bound = found.select(*joins.PATTERN, "p95_duration_ms")
    ranks = t.queries().select(*joins.PATTERN, "duration_ms").join(bound, list(joins.PATTERN)).groupBy(*joins.PATTERN).agg(
        F.count("duration_ms").alias("known"), F.count_if(F.col("duration_ms") <= F.col("p95_duration_ms")).alias("below")
    )
    off = F.abs(F.col("below") / F.col("known") - 0.95)
    close = ranks.select(*joins.PATTERN, (off <= daily.RANK_ERROR + 1 / F.col("known")).alias("p95_is_close"))
    return rounded(found.join(close, list(joins.PATTERN)).drop("p95_duration_ms"), "avg_duration_ms")


def _timeline(t: Tables) -> DataFrame:
    return rounded(ranking.pattern_timeline(t.queries(), feedback(t)), "duration_ms", "change_ms", "gain_ratio")


_TIMELINE_SQL = f"""
SELECT {_PATTERN}, captured_at AS at, 'EXECUTION' AS kind, id, CAST(duration_ms AS double) AS duration_ms,
  CAST(duration_ms - lag(duration_ms) OVER (PARTITION BY {_PATTERN} ORDER BY captured_at, id) AS double) AS change_ms,
  CAST(NULL AS double) AS gain_ratio
FROM q
UNION ALL
SELECT slow_query_fingerprint, NULL, NULL, checked_at, 'FEEDBACK', id, round(new_duration_ms, 6),
  round(new_duration_ms - old_duration_ms, 6), round(gain_ratio, 6)
FROM feedback"""

_TABLE_COLUMNS = (
    "source_db_type, source_db_host, table_name, query_count, "
    "round(avg_duration_ms, 6) AS avg_duration_ms, distinct_queries"
)
_BANDS = """count(*) AS total,
  count(*) FILTER (duration_ms > 2000) AS very_slow,
  count(*) FILTER (duration_ms > 500 AND duration_ms <= 2000) AS slow,
  count(*) FILTER (duration_ms <= 500) AS ok,
  round(count(*) FILTER (duration_ms > 2000) * 100.0 / count(*), 6) AS very_slow_percent,
  round(count(*) FILTER (duration_ms > 500 AND duration_ms <= 2000) * 100.0 / count(*), 6) AS slow_percent,
  round(count(*) FILTER (duration_ms <= 500) * 100.0 / count(*), 6) AS ok_percent"""
_TREND = f"""
SELECT CAST(captured_at AS date) AS date, count(*) AS query_count,
  round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms,
  CAST(max(duration_ms) AS double) AS max_duration_ms
FROM q WHERE captured_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1"""

ENTRIES: dict[str, Entry] = {
    "queries_with_analysis": Entry(
        lambda t: _joined(joins.queries_with_analysis(t.queries(), analyses(t))),
        sql(
            "SELECT q.id, fingerprint, status, problem, improvement_level FROM q "
            "LEFT JOIN a ON a.slow_query_id = q.id", "q", "a",
        ),
    ),
    "high_impact_queries": Entry(
        lambda t: _joined(joins.high_impact_queries(t.queries(), analyses(t))),
        sql(
            "SELECT q.id, fingerprint, status, problem, improvement_level FROM q "
            "JOIN a ON a.slow_query_id = q.id WHERE improvement_level IN ('HIGH', 'CRITICAL')", "q", "a",
        ),
    ),
    "representative_query": Entry(
        lambda t: joins.representative_query(t.queries()),
        sql(f"SELECT {_PATTERN}, max_by(id, (captured_at, id)) AS id FROM q GROUP BY {_PATTERN}", "q"),
    ),
    "schema_context": Entry(_context, sql(_CONTEXT_SQL, "q", "meta_tables")),
    "pattern_summary": Entry(
        lambda t: shown(summary(t)), sql(f"SELECT {SUMMARY_COLUMNS} FROM summary", "summary")
    ),
    "database_stats": Entry(
        lambda t: rounded(stats.database_stats(t.queries(), analyses(t)), "avg_duration_ms"),
        sql(
            "SELECT source_db_type, source_db_host, count(*) AS total_slow_queries, "
            "count(*) FILTER (status = 'ANALYZED') AS analyzed_queries, "
            "count(*) FILTER (status = 'NEW') AS pending_queries, "
            "round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms, "
            "count(*) FILTER (improvement_level IN ('HIGH', 'CRITICAL')) AS high_impact_count "
            "FROM q LEFT JOIN a ON a.slow_query_id = q.id GROUP BY source_db_type, source_db_host",
            "q", "a",
        ),
    ),
    "summary_of_days": Entry(
        _summary_of_days,
        sql(
            f"SELECT {_PATTERN}, id, execution_count, round(avg_duration_ms, 6) AS avg_duration_ms, min_duration_ms, "
            "max_duration_ms, total_duration_ms, last_seen, true AS p95_is_close FROM summary", "summary",
        ),
    ),
    "trend_of_days": Entry(
        lambda t: rounded(daily.trend_of_days(_days(t)), "avg_duration_ms"),
        sql(
            "SELECT CAST(captured_at AS date) AS date, count(*) AS query_count, "
            "round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms, "
            "CAST(max(duration_ms) AS double) AS max_duration_ms FROM q GROUP BY 1", "q",
        ),
    ),
    "global_totals": Entry(
        lambda t: stats.global_totals(t.queries()),
        sql(
            "SELECT count(*) AS total_slow_queries, count(*) FILTER (status = 'ANALYZED') AS total_analyzed, "
            "count(*) FILTER (status = 'NEW') AS total_pending, "
            "count(DISTINCT source_db_host) AS databases_monitored FROM q", "q",
        ),
    ),
    "improvement_summary": Entry(
        lambda t: stats.improvement_summary(
            joins.queries_with_analysis(t.queries(), analyses(t))
        ),
        sql(
            "SELECT coalesce(improvement_level, 'UNKNOWN') AS improvement_level, count(*) AS count "
            "FROM q LEFT JOIN a ON a.slow_query_id = q.id GROUP BY 1", "q", "a",
        ),
    ),
    "daily_trend": Entry(
        lambda t: rounded(stats.daily_trend(t.queries(), AS_OF), "avg_duration_ms"), sql(_TREND, "q")
    ),
    "monitored_databases": Entry(
        lambda t: stats.monitored_databases(t.queries()),
        sql(
            "SELECT source_db_type, source_db_host, source_db_name, count(*) AS slow_queries_count, "
            "max(captured_at) AS last_seen FROM q GROUP BY 1, 2, 3", "q",
        ),
    ),
    "analyzer_status": Entry(
        lambda t: stats.analyzer_status(t.queries(), analyses(t)),
        sql(
            "SELECT (SELECT count(*) FROM q WHERE status = 'NEW') AS pending, "
            "(SELECT count(*) FROM q WHERE status = 'ANALYZED') AS analyzed, "
            "(SELECT count(*) FROM q WHERE status = 'ERROR') AS error, "
            "(SELECT count(*) FROM q WHERE status <> 'IGNORED') AS total, "
            "(SELECT count(*) FROM a) AS analyses_total, "
            "(SELECT count(*) FROM a WHERE improvement_level = 'HIGH') AS high_impact, "
            "(SELECT count(*) FROM a WHERE improvement_level = 'MEDIUM') AS medium_impact, "
            "(SELECT count(*) FROM a WHERE improvement_level = 'LOW') AS low_impact", "q", "a",
        ),
    ),
    "impactful_tables": Entry(
        lambda t: rounded(stats.impactful_tables(t.queries()), "avg_duration_ms"),
        sql(f"SELECT {_TABLE_COLUMNS} FROM impactful", "impactful"),
    ),
    "impactful_tables_from_plan": Entry(
        lambda t: rounded(stats.impactful_tables(t.queries(), from_plan=True), "avg_duration_ms"),
        sql(
            "SELECT source_db_type, source_db_host, table_name, count(*) AS query_count, "
            "round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms, "
            "count(DISTINCT fingerprint) AS distinct_queries FROM (SELECT *, CASE source_db_type "
            "WHEN 'mysql' THEN json_extract_string(plan_json, '$.query_block.table.table_name') "
            "WHEN 'postgres' THEN json_extract_string(plan_json, '$.Plan.\"Relation Name\"') END AS table_name "
            "FROM q) x WHERE table_name IS NOT NULL GROUP BY source_db_type, source_db_host, table_name",
            "q",
        ),
    ),
    "pattern_list": Entry(
        lambda t: rounded(
            shown(
                learning.pattern_list(
                    summary(t), learning.pattern_effectiveness(evaluated(t), t.queries())
                )
            ),
            "last_suggestion_gain",
        ),
        sql(
            f"SELECT {SUMMARY_COLUMNS}, effectiveness_best, last_suggestion_gain FROM summary LEFT JOIN ("
            "SELECT fingerprint, CASE max(CASE state WHEN 'CONFIRMED' THEN 3 WHEN 'PENDING' THEN 2 ELSE 1 END) "
            "WHEN 3 THEN 'CONFIRMED' WHEN 2 THEN 'PENDING' ELSE 'FAILED' END AS effectiveness_best, "
            "round(max(gain_ratio) FILTER (state = 'CONFIRMED'), 6) AS last_suggestion_gain "
            "FROM evaluated GROUP BY fingerprint) e USING (fingerprint)",
            "summary", "evaluated",
        ),
    ),
    "case_band_summary": Entry(
        lambda t: rounded(
            stats.case_band_summary(t.queries()), "very_slow_percent", "slow_percent", "ok_percent"
        ),
        sql(
            f"SELECT category, {_BANDS} FROM marked GROUP BY category "
            f"UNION ALL SELECT 'ALL', {_BANDS} FROM marked", "marked",
        ),
    ),
    "source_counts": Entry(
        lambda t: stats.source_counts(t.queries()),
        sql("SELECT source_db_type, count(*) AS count FROM q GROUP BY source_db_type", "q"),
    ),
    "improvement_opportunities": Entry(
        lambda t: shown(stats.improvement_opportunities(summary(t))),
        sql(
            f"SELECT {SUMMARY_COLUMNS} FROM summary "
            "WHERE max_improvement_level IN ('MEDIUM', 'HIGH', 'CRITICAL')", "summary",
        ),
    ),
    "global_stats": Entry(_global, sql(_GLOBAL_SQL, "q", "a", "impactful")),
    "page_patterns": Entry(
        lambda t: shown(ranking.page_patterns(summary(t), page=2, page_size=20)),
        sql(
            f"SELECT {SUMMARY_COLUMNS} FROM (SELECT * FROM summary ORDER BY avg_duration_ms DESC, "
            f"{_PATTERN} LIMIT 20 OFFSET 20) s", "summary",
        ),
    ),
    "page_totals": Entry(
        lambda t: ranking.page_totals(summary(t), 20),
        sql(
            "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS bigint) AS total_pages FROM summary",
            "summary",
        ),
    ),
    "top_tables": Entry(
        lambda t: rounded(ranking.top_tables(stats.impactful_tables(t.queries())), "avg_duration_ms"),
        sql(
            f"SELECT {_TABLE_COLUMNS} FROM (SELECT * FROM impactful ORDER BY query_count DESC, "
            "source_db_type, source_db_host, table_name LIMIT 10) i", "impactful",
        ),
    ),
    "top_slow_patterns": Entry(
        lambda t: shown(ranking.top_slow_patterns(summary(t), min_duration_ms=1000)),
        sql(
            f"SELECT {SUMMARY_COLUMNS} FROM (SELECT * FROM summary WHERE avg_duration_ms >= 1000 "
            f"ORDER BY avg_duration_ms DESC, {_PATTERN} LIMIT 10) s", "summary",
        ),
    ),
    "unanalyzed_patterns": Entry(
        lambda t: shown(ranking.unanalyzed_patterns(summary(t, status="NEW"))),
        sql(
            f"SELECT {SUMMARY_COLUMNS} FROM (SELECT s.* EXCLUDE (id), r.id FROM ("
            f"SELECT {_PATTERN}, '' AS id, count(*) AS execution_count, "
            "CAST(sum(duration_ms) AS double) / count(*) AS avg_duration_ms, "
            "CAST(min(duration_ms) AS double) AS min_duration_ms, CAST(max(duration_ms) AS double) AS max_duration_ms, "
            "quantile_cont(CAST(duration_ms AS double), 0.95) AS p95_duration_ms, "
            "CAST(sum(duration_ms) AS double) AS total_duration_ms, max(captured_at) AS last_seen, "
            "false AS has_analysis, CAST(NULL AS varchar) AS max_improvement_level "
            f"FROM q WHERE status = 'NEW' GROUP BY {_PATTERN}) s JOIN (SELECT {_PATTERN}, "
            f"max_by(id, (captured_at, id)) AS id FROM q GROUP BY {_PATTERN}) r USING ({_PATTERN}) "
            f"ORDER BY avg_duration_ms DESC, {_PATTERN} LIMIT 10) s", "q",
        ),
    ),
    "slowest_cases": Entry(
        lambda t: ranking.slowest_cases(t.queries()),
        sql(
            "SELECT case_id, CAST(max(duration_ms) AS double) AS max_duration_ms FROM marked "
            "GROUP BY case_id ORDER BY max_duration_ms DESC, case_id LIMIT 5", "marked",
        ),
    ),
    "pattern_timeline": Entry(_timeline, sql(_TIMELINE_SQL, "q", "feedback")),
}
