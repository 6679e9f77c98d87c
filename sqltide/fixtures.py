"""Slow-query tables derived from the given tables.

Each derivation is one SELECT that Spark and an ANSI SQL engine read alike, so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.sources.ingest import with_fingerprint

AS_OF = "2024-01-31 00:00:00"


def slow_query_sql(events: str = "events") -> str:
    """Slow queries of three database types, with plans of every kind."""
    return f"""
SELECT
  concat('q-', CAST(event_id AS string)) AS id,
  CASE WHEN event_id % 10 = 9 THEN 'oracle' WHEN event_id % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS source_db_type,
  concat('host-', CAST(user_id % 5 AS string)) AS source_db_host,
  concat('db', CAST(user_id % 3 AS string)) AS source_db_name,
  CASE event_type
    WHEN 'click' THEN concat('SELECT * FROM orders WHERE user_id = ', CAST(user_id AS string), ' AND status = ''PAID'' limit ', CAST(event_id % 50 AS string))
    WHEN 'view' THEN concat('SELECT u.name, o.product  FROM users u JOIN orders o ON u.id = o.user_id WHERE u.country = ''C', CAST(user_id % 7 AS string), ''' AND o.price > ', CAST(value AS string))
    WHEN 'purchase' THEN concat('INSERT INTO orders VALUES (', CAST(event_id AS string), ', ''p', CAST(user_id AS string), ''', NOW())')
    WHEN 'signup' THEN concat('/* TEST:SCAN-00', CAST(1 + event_id % 5 AS string), ':Full_Table_Scan */ SELECT COUNT(*) FROM users WHERE email LIKE ''%x', CAST(user_id AS string), '%''')
    ELSE concat('UPDATE users SET name = ''n', CAST(user_id AS string), ''' WHERE id IN (', CAST(user_id AS string), ', ', CAST(event_id AS string), ');')
  END AS full_sql,
  CAST(CAST(round(value * 100) AS bigint) AS decimal(12,3)) AS duration_ms,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 7919) % 300000 END AS rows_examined,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE 1 + (event_id * 31) % 20000 END AS rows_returned,
  CASE
    WHEN event_type NOT IN ('click', 'view') OR event_id % 3 = 0 THEN NULL
    WHEN event_id % 10 = 9 THEN '{{"oracle": true}}'
    WHEN event_id % 2 = 0 THEN concat('{{"query_block": {{"select_id": 1, "table": {{"table_name": "orders", "access_type": "',
      CASE event_id % 8 WHEN 0 THEN 'ALL' WHEN 2 THEN 'index' WHEN 4 THEN 'ref' ELSE 'eq_ref' END,
      '", "rows_examined_per_scan": ', CAST((event_id * 7919) % 300000 AS string), '}}',
      CASE WHEN event_id % 14 = 0 THEN ', "ordering_operation": {{"using_filesort": false}}' ELSE '' END, '}}}}')
    ELSE concat('{{"Plan": {{"Node Type": "', CASE event_id % 7 WHEN 1 THEN 'Seq Scan' WHEN 3 THEN 'Nested Loop' ELSE 'Index Scan' END,
      '", "Relation Name": "orders", "Total Cost": ', CAST((event_id * 37) % 20000 AS string), '.25}}}}')
  END AS plan_json,
  ts AS captured_at,
  CASE WHEN event_id % 20 = 0 THEN 'IGNORED' WHEN event_id % 20 = 1 THEN 'ERROR' WHEN event_id % 20 < 12 THEN 'ANALYZED' ELSE 'NEW' END AS status
FROM {events}"""


def mysql_log_sql(q: str = "q0") -> str:
    """MySQL slow log: default databases, blank statements, exact duplicates.

    ``query_ms`` is the query time in milliseconds.
    """
    one = f"""
SELECT captured_at AS start_time, source_db_host AS user_host, duration_ms AS query_ms,
  rows_returned AS rows_sent, rows_examined,
  CASE source_db_name WHEN 'db0' THEN NULL WHEN 'db1' THEN '' ELSE source_db_name END AS db,
  CASE WHEN duration_ms < 1000 THEN '' WHEN duration_ms < 2000 THEN '   '
       WHEN duration_ms < 2500 THEN NULL ELSE full_sql END AS sql_text,
  plan_json
FROM {q} WHERE source_db_type = 'mysql'"""
    return f"{one} UNION ALL {one} AND full_sql LIKE 'INSERT%'"


def pg_stat_sql(q: str = "q0") -> str:
    """Statement statistics of the PostgreSQL rows, plus two internal statements."""
    return f"""
SELECT full_sql AS query, count(*) AS calls,
  CAST(sum(duration_ms) AS double) AS total_exec_time,
  CAST(sum(duration_ms) AS double) / count(*) AS mean_exec_time,
  CAST(max(duration_ms) AS double) AS max_exec_time,
  CAST(coalesce(sum(rows_returned), 0) AS bigint) AS rows,
  CAST(coalesce(sum(rows_examined), 0) AS bigint)
    - CAST(floor(coalesce(sum(rows_examined), 0) / 2) AS bigint) AS shared_blks_hit,
  CAST(floor(coalesce(sum(rows_examined), 0) / 2) AS bigint) AS shared_blks_read,
  '[' || max(plan_json) || ']' AS plan_json
FROM (SELECT full_sql, duration_ms, rows_returned, rows_examined, plan_json FROM {q}
      WHERE source_db_type = 'postgres'
      UNION ALL SELECT 'SELECT * FROM PG_CATALOG.pg_class', CAST(90000 AS decimal(12,3)), 1, 1, NULL
      UNION ALL SELECT 'select query from pg_stat_statements', CAST(80000 AS decimal(12,3)), 1, 1, NULL
      UNION ALL SELECT concat('VACUUM ', max(id)), CAST(2000000000 AS decimal(18,3)), 1, 1, NULL FROM {q}) s
GROUP BY full_sql"""


def statements_sql(orders: str = "orders") -> str:
    """Statement texts of many shapes, one per order: every text pattern occurs."""
    key, cust = "CAST(o_orderkey AS string)", "CAST(o_custkey AS string)"
    shapes = [
        f"concat('SELECT * FROM users WHERE id = ', {key})",
        f"concat('  select  name from users where id=-', {cust}, ' and price-', {key}, ' > 0x1F ;;')",
        f"concat('SELECT DISTINCT u.id FROM users u, orders o WHERE YEAR(o.created_at) = 2024 OR u.id = ', {cust})",
        f"concat('SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM orders WHERE price > ', CAST(o_totalprice AS string), ')')",
        f"concat('SELECT country, COUNT(*) FROM users GROUP BY country HAVING COUNT(*) > ', {cust}, ' LIMIT 10 OFFSET ', {key})",
        f"concat('INSERT INTO logs (id, note) VALUES (', {key}, ', ''it''''s'', \"x', {cust}, '\")')",
        f"concat('DELETE FROM carts WHERE id IN (', {key}, ', ', {cust}, ' , 3);')",
        f"concat('-- nightly', chr(10), 'SELECT count(*) FROM ', 'orders o LEFT JOIN users u ON o.user_id = u.id')",
        f"concat('UPDATE users SET name = ''n', {cust}, ''' WHERE UPPER(name) LIKE ''%', {key}, ''' or id = 1.5e', {cust})",
        f"concat('SELECT o.id, EXTRACT(YEAR FROM o.d) FROM db.orders o JOIN items i ON i.oid = o.id JOIN users u ON u.id = o.uid WHERE o.d > ''2024-01-', {cust}, ''' AND o.n = 2024-01-', {key})",
        "concat('CREATE TABLE t_', CAST(o_custkey AS string), ' (a int)')",
        "concat('ALTER TABLE t ADD c', CAST(o_orderkey AS string), ' int;')",
    ]
    cases = "\n".join(f"    WHEN {i} THEN {shape}" for i, shape in enumerate(shapes))
    return f"""
SELECT o_orderkey AS stmt_id,
  CASE o_orderkey % {len(shapes)}
{cases}
  END AS sql_text
FROM {orders}"""


def nested_plan_sql(orders: str = "orders") -> str:
    """Plans with joins, sorts and nested children, one per order."""
    rows, key = "CAST(o_custkey * 977 AS string)", "CAST(o_orderkey AS string)"
    return f"""
SELECT concat('p-', {key}) AS id,
  CASE o_orderstatus WHEN 'F' THEN 'mysql' ELSE 'postgres' END AS source_db_type,
  CASE o_orderstatus
    WHEN 'F' THEN concat('{{"query_block": {{"select_id": 1, "ordering_operation": {{"using_filesort": true, "nested_loop": [{{"table": {{"table_name": "o", "access_type": "ALL", "rows_examined_per_scan": ', {rows}, '}}}}, {{"table": {{"table_name": "u", "access_type": "eq_ref", "rows_examined_per_scan": 1}}}}]}}}}}}')
    ELSE concat('{{"Plan": {{"Node Type": "Sort", "Plan Rows": 10, "Plans": [{{"Node Type": "Nested Loop", "Plan Rows": ', {rows}, ', "Plans": [{{"Node Type": "Seq Scan", "Relation Name": "orders", "Plan Rows": ', {rows}, '}}, {{"Node Type": "Index Scan", "Relation Name": "users", "Plan Rows": 1}}]}}]}}}}')
  END AS plan_json
FROM {orders}"""


def metadata_sql(q: str = "q0") -> str:
    """Daily snapshots per database: row counts of two tables."""
    return f"""
SELECT source_db_type, source_db_host, source_db_name,
  max(captured_at) AS captured_at,
  count(*) AS orders_rows,
  CAST(coalesce(sum(rows_examined), 0) AS bigint) AS users_rows
FROM {q}
GROUP BY source_db_type, source_db_host, source_db_name, CAST(captured_at AS date)"""


def replies_sql(q: str = "q0") -> str:
    """Model replies: JSON, broken JSON, JSON that is no object, none."""
    return f"""
SELECT id AS slow_query_id,
  CASE
    WHEN full_sql LIKE 'SELECT *%' THEN concat('{{"root_cause": "cause ', id, '", "problem_summary": "problem", "index_recommendations": [{{"sql": "CREATE INDEX i ON orders(user_id)", "rationale": "filter", "impact": "10x"}}], "query_optimizations": [{{"type": "rewrite", "description": "no star", "example": "SELECT id"}}], "improvement_level": "CRITICAL", "estimated_speedup": "50x", "confidence": ', CASE WHEN id LIKE '%7' THEN '95' ELSE '0.95' END, '}}')
    WHEN full_sql LIKE 'SELECT u%' THEN '{{"index_recommendations": [], "problem_summary": ""}}'
    WHEN full_sql LIKE 'INSERT%' THEN concat('The statement ', full_sql, ' is {{not JSON', repeat(' and so on', 60))
    WHEN full_sql LIKE 'UPDATE%' THEN '["a list"]'
    ELSE NULL
  END AS reply
FROM {q}"""


def _case_sql(part: str, tail: str) -> str:
    name = "replace(p_name, ' ', '_')"
    brand = "lower(replace(p_brand, '#', '_'))"
    return f"""
SELECT concat('SELECT ', {name}, ' FROM ', {brand}, ' JOIN ', lower(p_type),
    ' ON id = ref_id WHERE size_', CAST(p_size AS string), ' = ? AND c_',
    CAST(CAST(floor(p_retailprice) AS bigint) AS string), {tail}) AS fingerprint,
  CASE p_type WHEN 'ECONOMY' THEN 'postgres' ELSE 'mysql' END AS db_type,
  min(p_partkey) AS part_key,
  CAST(max(p_retailprice) AS double) AS price
FROM {part} GROUP BY 1, 2"""


def cases_sql(part: str = "part") -> str:
    """Knowledge cases, one per pattern and type, of every effectiveness."""
    return f"""
SELECT concat('k-', CAST(part_key AS string)) AS id, fingerprint, db_type, fingerprint AS full_sql,
  CASE WHEN db_type = 'mysql' THEN concat('{{"query_block": {{"table": {{"table_name": "brand", "access_type": "',
      CASE WHEN price > 960 THEN 'ALL' ELSE 'ref' END, '"}}}}}}')
    ELSE NULL END AS plan_json,
  CASE WHEN price > 975 THEN 'Sequential scan detected' WHEN price > 950 THEN 'Full table scan detected'
    ELSE 'Slow query detected' END AS problem,
  price AS old_duration_ms,
  1000.0 AS new_duration_ms,
  (price - 900) / 150 AS gain_ratio,
  CASE WHEN price > 940 THEN 'CONFIRMED' WHEN price > 920 THEN 'PENDING' ELSE 'FAILED' END AS effectiveness
FROM ({_case_sql(part, "' = ?'")}) c"""


def new_patterns_sql(part: str = "part") -> str:
    """Patterns to find similar cases for."""
    return f"""
SELECT fingerprint, db_type, CAST(NULL AS string) AS plan_json
FROM ({_case_sql(part, "' > ? ORDER BY rank'")}) c"""


USERS_SQL = """
SELECT c_custkey AS id, c_name AS name, concat(c_name, '@x') AS email, c_mktsegment AS country
FROM {customer}"""
LAB_ORDERS_SQL = """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS product, o_totalprice AS price,
  CASE o_orderstatus WHEN 'P' THEN 'PAID' WHEN 'F' THEN 'SHIPPED' ELSE 'OPEN' END AS status,
  o_orderdate AS created_at
FROM {orders}"""


class Tables:
    """The derived tables as DataFrames over one folder of the given tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _file(self, name: str) -> str:
        """A view of a given table."""
        view = f"given_{name}_{zlib.crc32(self.folder.encode())}"
        self.given(name).createOrReplaceTempView(view)
        return view

    def _over_queries(self, build) -> DataFrame:
        inner = f"({slow_query_sql(self._file('events'))}) q0"
        return self.spark.sql(build(inner))

    def queries(self) -> DataFrame:
        return with_fingerprint(self.spark.sql(slow_query_sql(self._file("events"))))

    def mysql_log(self) -> DataFrame:
        log = self._over_queries(mysql_log_sql)
        seconds = (F.col("query_ms") / 1000).cast("decimal(18,6)")
        return log.withColumn("query_time", F.make_dt_interval(secs=seconds)).drop("query_ms")

    def pg_stat(self) -> DataFrame:
        return self._over_queries(pg_stat_sql)

    def statements(self) -> DataFrame:
        return self.spark.sql(statements_sql(self._file("orders")))

    def nested_plans(self) -> DataFrame:
        return self.spark.sql(nested_plan_sql(self._file("orders")))

    def metadata(self) -> DataFrame:
        flat = self._over_queries(metadata_sql)
        return flat.select(
            "source_db_type",
            "source_db_host",
            "source_db_name",
            "captured_at",
            F.array(
                F.struct(F.lit("orders").alias("name"), F.col("orders_rows").alias("row_count")),
                F.struct(F.lit("users").alias("name"), F.col("users_rows").alias("row_count")),
            ).alias("tables"),
            F.array(
                F.struct(F.lit("users").alias("table"), F.lit("users_pk").alias("name")),
                F.struct(F.lit("orders").alias("table"), F.lit("orders_pk").alias("name")),
                F.struct(F.lit("users").alias("table"), F.lit("idx_email").alias("name")),
            ).alias("indexes"),
        )

    def replies(self) -> DataFrame:
        return self._over_queries(replies_sql)

    def cases(self) -> DataFrame:
        from sqltide.plans.rules import suggestion, suggestions

        flat = self.spark.sql(cases_sql(self._file("part")))
        kind = F.when(F.col("problem") == "Slow query detected", F.lit("REVIEW")).otherwise("INDEX")
        item = suggestion(kind, "HIGH", F.concat(F.lit("fix "), F.col("id")))
        return flat.select(
            "*",
            F.lit(None).cast("string").alias("schema_context"),
            suggestions(item).alias("suggestions"),
            F.lit(None).cast("string").alias("applied_fix"),
            F.lit("1.0.0").alias("analyzer_version"),
            F.to_timestamp_ntz(F.lit(AS_OF)).alias("created_at"),
            F.to_timestamp_ntz(F.lit(AS_OF)).alias("updated_at"),
        )

    def new_patterns(self) -> DataFrame:
        return self.spark.sql(new_patterns_sql(self._file("part")))

    def users(self) -> DataFrame:
        return self.spark.sql(USERS_SQL.format(customer=self._file("customer")))

    def lab_orders(self) -> DataFrame:
        return self.spark.sql(LAB_ORDERS_SQL.format(orders=self._file("orders")))
