"""Statement-text, measure and plan functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqltide.fixtures import Tables
from sqltide.functions import measures, predicates, text
from sqltide.functions.plan_json import plan_features
from sqltide.registry.base import Entry, analyses
from sqltide.registry.oracle import level_rank, normalized, sql, tables_of
from sqltide.sources.ingest import with_fingerprint
from sqltide.sources.store import latest_db_metadata



def _over_statements(name: str, function: Callable[[Column], Column]):
    """A text function over every statement."""
    return lambda t: t.statements().select("stmt_id", function(F.col("sql_text")).alias(name))


def _type_sql(column: str) -> str:
    first = f"upper(regexp_extract({column}, '^\\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)', 1, 'i'))"
    return f"CASE {first} WHEN '' THEN 'OTHER' ELSE {first} END"


# Statements as text, and as the hex text some drivers hand over, whole or damaged.
_ENCODED = (
    "SELECT stmt_id, sql_text, CASE WHEN sql_text LIKE 'SELECT%' THEN concat('\\x', lower(hex(sql_text))) "
    "WHEN sql_text LIKE 'INSERT%' THEN concat('\\x', hex(sql_text), 'f') "
    "WHEN sql_text LIKE 'DELETE%' THEN concat('\\xff', hex(sql_text)) "
    "WHEN sql_text LIKE 'UPDATE%' THEN concat('\\xzz', sql_text) ELSE sql_text END AS encoded FROM statements"
)


def _encoded(t: Tables):
    statement, head = F.col("sql_text"), F.lit("\\x")
    as_hex = F.hex(statement.cast("binary"))
    return t.statements().withColumn(
        "encoded",
        F.when(statement.startswith("SELECT"), F.concat(head, F.lower(as_hex)))
        .when(statement.startswith("INSERT"), F.concat(head, as_hex, F.lit("f")))
        .when(statement.startswith("DELETE"), F.concat(head, F.lit("ff"), as_hex))
        .when(statement.startswith("UPDATE"), F.concat(head, F.lit("zz"), statement))
        .otherwise(statement),
    )


def _bytes(t: Tables):
    broken = F.concat(F.col("sql_text").cast("binary"), F.unhex(F.lit("FFC3")))
    return t.statements().select("stmt_id", text.decode_bytes(broken).alias("decoded"))


def _markers(t: Tables):
    marker = text.test_marker(F.col("full_sql"))
    return t.queries().select("id", marker.alias("m")).select("id", "m.*")


def _intervals(t: Tables):
    return t.mysql_log().groupBy("user_host").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(measures.interval_to_ms(F.col("query_time"))).cast("double").alias("total_ms"),
        F.max(measures.interval_to_ms(F.col("query_time"))).cast("double").alias("max_ms"),
    )


def _durations(t: Tables):
    ms = F.col("o_totalprice") / 4
    return t.given("orders").select("o_orderkey", measures.duration_label(ms).alias("label"))


def _fixed_sql(value: str, digits: int) -> str:
    # Two digits tie on odd eighths, none on odd halves; ties go up.
    tie = f"({value} * {2 ** (digits + 1)}) % 2 = 1"
    return f"printf('%.{digits}f', {value} + CASE WHEN {tie} THEN {0.25 / 10**digits} ELSE 0 END)"


def _previews(t: Tables):
    p = F.col("fingerprint")
    return t.queries().select(
        "id",
        text.query_preview(p, 40).alias("list_preview"),
        text.query_preview(p, 80, always=True).alias("top_preview"),
    )


# The keywords of the derived queries and cases, written out here.
KEYWORDS = ", ".join(
    f"'{word}'"
    for word in (
        "select", "from", "join", "on", "where", "and", "limit", "like", "insert", "into", "values", "update", "set", "in",
    )
)


def anonymous_sql(column: str, relation: str, key: str) -> str:
    """Oracle of the anonymiser: one row per ``key`` with ``anonymous``."""
    literal = f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"
    for pattern in (
        r"''(?:[^''\\]|\\.)*''", r'"(?:[^"\\\\]|\\\\.)*"', r"\b-?\d+\.?\d*\b", r"\b0x[0-9a-fA-F]+\b",
    ):
        literal = f"regexp_replace({literal}, '{pattern}', '?', 'g')"
    name = r"\s+([a-zA-Z_][a-zA-Z0-9_]*)"
    return f"""
SELECT {key}, array_to_string(list_transform(words, lambda w:
  CASE WHEN list_contains(tables, lower(w)) THEN 'table_' || list_position(tables, lower(w))
       WHEN list_contains(cols, lower(w)) THEN 'col_' || list_position(cols, lower(w)) ELSE w END), '') AS anonymous
FROM (
  SELECT {key}, words, tables,
    list_filter(raw, lambda x, i: list_position(raw, x) = i) AS cols
  FROM (
    SELECT {key}, words, tables, list_filter(list_transform(list_filter(range(1, len(words) + 1), lambda i:
        regexp_matches(words[i], '^[a-zA-Z_]') AND lower(words[i]) NOT IN ({KEYWORDS})
        AND NOT list_contains(tables, lower(words[i]))
        AND NOT regexp_matches(coalesce(words[i + 1], ''), '^ ?\\(')), lambda i: lower(words[i])),
      lambda x: x IS NOT NULL) AS raw
    FROM (
      SELECT {key}, regexp_extract_all(bare, '[a-zA-Z_][a-zA-Z0-9_$]*|[^a-zA-Z_]+') AS words,
        list_filter(found, lambda x, i: list_position(found, x) = i AND x NOT IN ({KEYWORDS})) AS tables
      FROM (
        SELECT {key}, bare, list_concat(list_concat(
          regexp_extract_all(lower(bare), '\\bfrom{name}', 1),
          regexp_extract_all(lower(bare), '\\bjoin{name}', 1)),
          regexp_extract_all(lower(bare), '\\b(?:into|update|table){name}', 1)) AS found
        FROM (SELECT {key}, {literal} AS bare FROM {relation}) b) f) w) r) c"""


# What each of the derived statements' shapes becomes, by hand: without names and literals, its
# antipatterns, and those of its predicates.
_SHAPES = (
    ("SELECT * FROM table_1 WHERE col_1 = ?", "SELECT_STAR", ""),
    ("select col_1 from table_1 where col_2=-? and col_3? > ? ;;", "", "MATH_ON_COLUMN"),
    (
        "SELECT DISTINCT col_1.col_2 FROM table_1 col_1, col_3 col_4 WHERE YEAR(col_4.col_5) = ? OR col_1.col_2 = ?",
        "OR_CONDITION,FUNCTION_ON_COLUMN,DISTINCT,COMMA_JOIN", "JOIN_WITHOUT_CONDITION",
    ),
    (
        "SELECT col_1 FROM table_1 WHERE col_1 NOT IN (SELECT col_2 FROM table_2 WHERE col_3 > ?)",
        "NOT_IN,IN_SUBQUERY", "",
    ),
    (
        "SELECT col_1, COUNT(*) FROM table_1 GROUP BY col_1 HAVING COUNT(*) > ? LIMIT ? OFFSET ?",
        "NO_WHERE,HAVING", "",
    ),
    ("INSERT INTO table_1 (col_1, col_2) VALUES (?, ??, ?)", "", ""),
    ("DELETE FROM table_1 WHERE col_1 IN (?, ? , ?);", "", ""),
    (
        "-- col_1 SELECT count(*) FROM table_1 col_2 LEFT JOIN table_2 col_3 ON col_2.col_4 = col_3.col_5", "", "",
    ),
    (
        "UPDATE table_1 SET col_1 = ? WHERE UPPER(col_1) LIKE ? or col_2 = ?5col_3",
        "LEADING_WILDCARD,OR_CONDITION,FUNCTION_ON_COLUMN", "",
    ),
    (
        "SELECT table_1.col_1, EXTRACT(YEAR FROM table_1.col_2) FROM table_2.col_3 table_1 "
        "JOIN table_3 col_4 ON col_4.col_5 = table_1.col_1 JOIN table_4 col_6 ON col_6.col_1 = table_1.col_7 "
        "WHERE table_1.col_2 > ? AND table_1.col_8 = ???",
        "", "",
    ),
    ("CREATE TABLE table_1 (col_1 int)", "", ""),
    ("ALTER TABLE table_1 ADD col_1 int;", "", ""),
)


def _by_shape(column: int, name: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{shape[column]}'" for i, shape in enumerate(_SHAPES))
    return f"SELECT o_orderkey AS stmt_id, CASE o_orderkey % {len(_SHAPES)} {cases} END AS {name} FROM orders"


def _columns(t: Tables):
    """Columns of every database: ids of users are numbers, those that orders hold are texts."""
    kinds = {
        "users": {"id": "bigint", "name": "varchar(80)", "email": "varchar(80)", "country": "char(2)"},
        "orders": {"id": "bigint", "user_id": "varchar(20)", "product": "text", "price": "varchar(20)", "status": "text"},
    }
    rows = [(table, column, kind) for table, own in kinds.items() for column, kind in own.items()]
    named = t.spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
    held = latest_db_metadata(t.metadata()).select("source_db_type", "source_db_host", "source_db_name", "table_name")
    return held.join(named, "table_name")


def _type_flags(t: Tables):
    found = predicates.type_flags(t.queries(), _columns(t))
    return found.select("id", F.array_join("flags", ",").alias("flags"))



def _features(t: Tables):
    plan = plan_features(F.col("plan_json"), F.col("source_db_type"))
    return t.queries().select("id", plan.alias("p")).select(
        "id", "p.access_type", "p.table_name",
        F.col("p.rows_examined_per_scan").cast("bigint").alias("rows_examined_per_scan"),
        "p.has_filesort", "p.node_type", "p.relation_name", "p.total_cost",
    )


_FEATURES_SQL = """
SELECT id, json_extract_string(plan_json, '$.query_block.table.access_type') AS access_type,
  json_extract_string(plan_json, '$.query_block.table.table_name') AS table_name,
  CAST(json_extract_string(plan_json, '$.query_block.table.rows_examined_per_scan') AS bigint) AS rows_examined_per_scan,
  CASE WHEN source_db_type = 'mysql' THEN coalesce(contains(lower(CAST(json_extract(plan_json, '$.query_block') AS varchar)), 'filesort'), false) END AS has_filesort,
  json_extract_string(plan_json, '$.Plan."Node Type"') AS node_type,
  json_extract_string(plan_json, '$.Plan."Relation Name"') AS relation_name,
  CAST(json_extract_string(plan_json, '$.Plan."Total Cost"') AS double) AS total_cost
FROM q"""


def _gains(t: Tables):
    old, new = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return t.given("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(measures.gain_ratio(old, new), 6).alias("gain_ratio"),
        measures.gain_ratio(F.col("l_tax") * 0, new).alias("no_base"),
    )


ENTRIES: dict[str, Entry] = {
    "normalize_query": Entry(
        _over_statements("pattern", text.normalize_query),
        sql(f"SELECT stmt_id, {normalized('sql_text')} AS pattern FROM statements", "statements"),
    ),
    "sql_hash": Entry(
        _over_statements("sql_hash", lambda c: text.sql_hash(text.normalize_query(c))),
        sql(f"SELECT stmt_id, md5({normalized('sql_text')}) AS sql_hash FROM statements", "statements"),
    ),
    "fingerprint": Entry(
        lambda t: with_fingerprint(t.queries().select("id", "full_sql")).drop("full_sql"),
        sql("SELECT id, fingerprint, sql_hash FROM q", "q"),
    ),
    "extract_tables": Entry(
        _over_statements("tables", lambda c: F.array_join(text.extract_tables(c), ",")),
        sql(
            f"SELECT stmt_id, array_to_string({tables_of('sql_text')}, ',') AS tables FROM statements",
            "statements",
        ),
    ),
    "classify_query_type": Entry(
        _over_statements("query_type", text.classify_query_type),
        sql(f"SELECT stmt_id, {_type_sql('sql_text')} AS query_type FROM statements", "statements"),
    ),
    "is_explain_safe": Entry(
        _over_statements("safe", text.is_explain_safe),
        sql(f"SELECT stmt_id, ({_type_sql('sql_text')}) = 'SELECT' AS safe FROM statements", "statements"),
    ),
    "decode_hex_sql": Entry(
        lambda t: _encoded(t).select(
            "stmt_id", "encoded", text.decode_hex_sql(F.col("encoded")).alias("decoded")
        ),
        sql(
            "SELECT stmt_id, encoded, CASE WHEN sql_text LIKE 'SELECT%' THEN sql_text ELSE encoded END "
            f"AS decoded FROM ({_ENCODED}) e",
            "statements",
        ),
    ),
    "decode_bytes": Entry(
        _bytes,
        sql("SELECT stmt_id, concat(sql_text, chr(65533), chr(65533)) AS decoded FROM statements", "statements"),
    ),
    "test_marker": Entry(
        _markers,
        sql(
            "SELECT q.id, m.category, m.case_id, m.case_name FROM q LEFT JOIN marked m ON m.id = q.id",
            "q", "marked",
        ),
    ),
    "interval_to_ms": Entry(
        _intervals,
        sql(
            "SELECT user_host, count(*) AS n, CAST(sum(query_ms) AS double) AS total_ms, "
            "CAST(max(query_ms) AS double) AS max_ms FROM mysql_log GROUP BY user_host",
            "mysql_log",
        ),
    ),
    "duration_label": Entry(
        _durations,
        f"SELECT o_orderkey, CASE WHEN ms < 1000 THEN {_fixed_sql('ms', 0)} || 'ms' "
        f"WHEN ms < 60000 THEN {_fixed_sql('(ms / 1000)', 2)} || 's' "
        f"ELSE {_fixed_sql('(ms / 60000)', 2)} || 'm' END AS label "
        "FROM (SELECT o_orderkey, o_totalprice / 4 AS ms FROM orders) o",
    ),
    "query_preview": Entry(
        _previews,
        sql(
            "SELECT id, CASE WHEN length(fingerprint) > 40 THEN substr(fingerprint, 1, 40) || '...' "
            "ELSE fingerprint END AS list_preview, substr(fingerprint, 1, 80) || '...' AS top_preview FROM q",
            "q",
        ),
    ),
    "efficiency_ratio": Entry(
        lambda t: t.queries().select(
            "id",
            F.round(
                measures.efficiency_ratio(F.col("rows_examined"), F.col("rows_returned")), 6
            ).alias("ratio"),
        ),
        sql(
            "SELECT id, CASE WHEN rows_examined > 0 THEN round(CAST(rows_examined AS double) / "
            "CASE WHEN coalesce(rows_returned, 1) < 1 THEN 1 ELSE coalesce(rows_returned, 1) END, 6) END "
            "AS ratio FROM q",
            "q",
        ),
    ),
    "anonymize_sql": Entry(
        _over_statements("anonymous", text.anonymize_sql),
        _by_shape(0, "anonymous")
    ),
    "make_fingerprint": Entry(
        _over_statements("pattern", text.make_fingerprint),
        sql(f"SELECT stmt_id, lower({normalized('sql_text')}) AS pattern FROM statements", "statements"),
    ),
    "improvement_rank": Entry(
        lambda t: analyses(t).select(
            "slow_query_id", measures.improvement_rank(F.col("improvement_level")).alias("rank")
        ),
        sql(f"SELECT slow_query_id, {level_rank('improvement_level')} AS rank FROM a", "a"),
    ),
    "antipattern_flags": Entry(
        _over_statements("flags", lambda c: F.array_join(text.antipattern_flags(c), ",")),
        _by_shape(1, "flags"),
    ),
    "predicate_flags": Entry(
        _over_statements("flags", lambda c: F.array_join(predicates.predicate_flags(c), ",")),
        _by_shape(2, "flags"),
    ),
    "type_flags": Entry(
        _type_flags,
        sql(
            "SELECT id, CASE WHEN contains(full_sql, 'JOIN') THEN 'TYPE_JOIN_MISMATCH,TYPE_TEXT_NUMBER' "
            "WHEN contains(full_sql, 'FROM orders') THEN 'TYPE_TEXT_NUMBER' ELSE '' END AS flags FROM q", "q",
        ),
    ),
    "plan_features": Entry(_features, sql(_FEATURES_SQL, "q")),
    "gain_ratio": Entry(
        _gains,
        "SELECT l_orderkey, l_linenumber, l_partkey, "
        "round((l_extendedprice - l_quantity * 1000) / l_extendedprice, 6) AS gain_ratio, "
        "CAST(NULL AS double) AS no_base FROM lineitem",
    ),
}
