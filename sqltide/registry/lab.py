"""The lab workload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltide.fixtures import Tables
from sqltide.functions.measures import interval_to_ms
from sqltide.operators import workload
from sqltide.registry.base import Entry
from sqltide.registry.oracle import sql

_GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _in_ms(df):
    return df.withColumn("query_time", interval_to_ms(F.col("query_time")).cast("double"))


def _counts(t: Tables):
    return workload.table_row_counts({name: t.given(name) for name in _GIVEN})


_REWRITES_SQL = """
SELECT 'SUB-004' AS case_id, count(*) AS rows_written, CAST(0 AS bigint) AS rows_different FROM users u
  WHERE NOT EXISTS (SELECT 1 FROM lab_orders o WHERE o.user_id = u.id)
UNION ALL SELECT 'SUB-002', count(*), 0 FROM lab_orders o JOIN (
  SELECT user_id, sum(CAST(price AS decimal(18,2))) AS s, count(*) AS n FROM lab_orders GROUP BY user_id) m
  ON m.user_id = o.user_id WHERE CAST(o.price AS decimal(18,2)) * n > s
UNION ALL SELECT 'SUB-001', count(*), 0 FROM users
UNION ALL SELECT 'OR-002', count(*), 0 FROM lab_orders WHERE status = 'PAID' OR product = '1-URGENT'
UNION ALL SELECT 'OR-003', count(*), 0 FROM lab_orders WHERE status IN ('PAID', 'SHIPPED')
UNION ALL SELECT 'JOIN-004', count(*), 0 FROM (
  SELECT user_id FROM lab_orders GROUP BY user_id HAVING count(DISTINCT status) > 1) x
UNION ALL SELECT 'AGG-003', count(DISTINCT status), 0 FROM lab_orders WHERE status <> 'OPEN'"""

ENTRIES: dict[str, Entry] = {
    "like_filter_count": Entry(
        lambda t: workload.like_filter_count(t.lab_orders(), "%HIGH%", "PAID"),
        sql(
            "SELECT count(*) AS cnt FROM lab_orders WHERE product LIKE '%HIGH%' AND status = 'PAID'",
            "lab_orders",
        ),
    ),
    "join_filter_count": Entry(
        lambda t: workload.join_filter_count(t.users(), t.lab_orders(), "BUILDING", "SHIPPED"),
        sql(
            "SELECT count(*) AS cnt FROM users u JOIN lab_orders o ON u.id = o.user_id "
            "WHERE u.country = 'BUILDING' AND o.status = 'SHIPPED'", "users", "lab_orders",
        ),
    ),
    "group_count_ordered": Entry(
        lambda t: workload.group_count_ordered(t.users()),
        sql("SELECT country, count(*) AS cnt FROM users GROUP BY country", "users"),
    ),
    "left_join_having_topk": Entry(
        lambda t: workload.left_join_having_topk(t.users(), t.lab_orders(), ["PAID", "SHIPPED"]),
        sql(
            "SELECT u.country, count(o.id) AS order_count, "
            "CAST(sum(CAST(o.price AS decimal(18,2))) AS double) AS total_revenue FROM users u "
            "LEFT JOIN lab_orders o ON u.id = o.user_id WHERE o.status IN ('PAID', 'SHIPPED') "
            "GROUP BY u.country HAVING count(o.id) > 10 ORDER BY total_revenue DESC, country LIMIT 10",
            "users", "lab_orders",
        ),
    ),
    "top_statements": Entry(
        lambda t: workload.top_statements(t.pg_stat()),
        sql(
            "SELECT calls, CAST(round(CAST(total_exec_time AS decimal(30,6)) / 1000, 2) AS double) AS total_time_sec, "
            "CAST(round(CAST(mean_exec_time AS decimal(30,6)) / 1000, 2) AS double) AS avg_time_sec, "
            "substr(query, 1, 80) AS query_preview FROM pg_stat WHERE query NOT ILIKE '%pg_stat_statements%' "
            "AND query NOT ILIKE '%pg_catalog%' ORDER BY mean_exec_time DESC, query LIMIT 5", "pg_stat",
        ),
    ),
    "latest_statements": Entry(
        lambda t: _in_ms(workload.latest_statements(t.mysql_log())),
        sql(
            "SELECT start_time, CAST(query_ms AS double) AS query_time, substr(sql_text, 1, 80) AS query_preview "
            "FROM mysql_log ORDER BY start_time DESC, sql_text LIMIT 5", "mysql_log",
        ),
    ),
    "antipattern_rewrites": Entry(
        lambda t: workload.rewrites_agree(t.users(), t.lab_orders()),
        sql(_REWRITES_SQL, "users", "lab_orders"),
    ),
    "table_row_counts": Entry(
        _counts,
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in _GIVEN
        ),
    ),
    "join_projection": Entry(
        lambda t: workload.join_projection(t.users(), t.lab_orders(), "BUILDING", "SHIPPED", 1000.0),
        sql(
            "SELECT u.name, o.product, o.price FROM users u JOIN lab_orders o ON u.id = o.user_id "
            "WHERE u.country = 'BUILDING' AND o.status = 'SHIPPED' AND o.price > 1000", "users", "lab_orders",
        ),
    ),
    "slowest_statements": Entry(
        lambda t: _in_ms(workload.slowest_statements(t.mysql_log())),
        sql(
            "SELECT start_time, sql_text, CAST(query_ms AS double) AS query_time FROM mysql_log "
            "ORDER BY query_ms DESC, start_time, sql_text LIMIT 10", "mysql_log",
        ),
    ),
}
