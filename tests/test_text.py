from __future__ import annotations

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sqltide.functions import measures, text


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v"))).first()[0]


PATTERNS = {
    "SELECT title FROM books WHERE shelf = 17": "SELECT title FROM books WHERE shelf = ?",
    "SELECT * FROM boats WHERE harbour = 'Kiel' AND length >= 12.25": (
        "SELECT * FROM boats WHERE harbour = ? AND length >= ?"
    ),
    "INSERT INTO tides VALUES ('low', 3, RAND())": "INSERT INTO tides VALUES (?, ?, RAND())",
    "DELETE FROM nets WHERE owner = 'Ida' OR mesh < 8": "DELETE FROM nets WHERE owner = ? OR mesh < ?",
    "  a \n\t b  ": "a b",
    "price-100": "price?",
    "2024-01-01": "???",
    "1.5e10": "?5e10",
    "a=-5": "a=-?",
    "'it''s'": "??",
    '"x\\"y"': '"x\\?',
    "x IN (1, 2 , 'a')": "x IN (?)",
    "select 1 limit 5 offset 10": "select ? LIMIT ?",
    "select 1 offset 10": "select ? OFFSET ?",
    "select 0x1F;;": "select ?",
    "select 1 ;": "select ? ",
    "SELECT 'a\\'b', 3": "SELECT ?, ?",
    # letters and digits of any alphabet
    "é1 = 2é": "é1 = 2é",
    "n = ٣": "n = ?",
    "a\x1cb": "a b",
    "": "",
}


@pytest.mark.parametrize("sql", list(PATTERNS))
def test_normalize_query(spark, sql):
    assert one(spark, sql, text.normalize_query) == PATTERNS[sql]


def test_normalize_null_and_hash(spark):
    assert one(spark, None, text.normalize_query) == ""
    assert one(spark, None, text.sql_hash) == ""
    assert one(spark, "", text.sql_hash) == ""
    assert one(spark, "abc", text.sql_hash) == "900150983cd24fb0d6963f7d28e17f72"


def test_long_literals_and_lists_do_not_overflow(spark):
    quoted = "SELECT '" + "a\\'" * 100_000 + "', 5"
    listed = "x IN (" + ", ".join(str(i) for i in range(100_000)) + ")"
    assert one(spark, quoted, text.normalize_query) == "SELECT ?, ?"
    assert one(spark, listed, text.normalize_query) == "x IN (?)"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**9), st.integers(0, 10**9), st.text("abc xyz", max_size=8))
def test_statements_that_differ_in_literals_share_a_pattern(spark, one_id, other_id, name):
    statements = [
        f"SELECT * FROM t WHERE id = {one_id} AND n = 'x'",
        f"SELECT * FROM t WHERE id = {other_id} AND n = '{name}'",
    ]
    df = spark.createDataFrame([(s,) for s in statements], "v string")
    assert df.select(text.normalize_query(F.col("v"))).distinct().count() == 1


def test_make_fingerprint(spark):
    sql = "SELECT * FROM orders WHERE user_id = 1234 AND status = 'PAID' LIMIT 10;"
    expected = "select * from orders where user_id = ? and status = ? limit ?"
    assert one(spark, sql, text.make_fingerprint) == expected


def test_extract_tables(spark):
    cases = {
        "SELECT 1 FROM a JOIN b ON 1=1 JOIN a ON 2=2 WHERE x IN (SELECT y FROM c)": ["a", "c", "b"],
        "select 1 from db.t": ["db"],
        'select 1 from "q"': [],
        "SELECT EXTRACT(YEAR FROM d) FROM T": ["d", "t"],
    }
    for sql, names in cases.items():
        assert one(spark, sql, text.extract_tables) == names
    assert one(spark, None, text.extract_tables) == []


def test_classify(spark):
    kinds = {
        " select 1": "SELECT", "SELECTED": "SELECT", "WITH x AS (SELECT 1) SELECT 1": "OTHER",
        "/* c */ SELECT 1": "OTHER", "drop table t": "DROP", "": "OTHER",
    }
    for sql, kind in kinds.items():
        assert one(spark, sql, text.classify_query_type) == kind
    marked = "/* TEST:SCAN-001:X */ -- note\n SELECT 1"
    assert one(spark, marked, text.is_explain_safe) is False
    assert one(spark, marked, lambda c: text.classify_query_type(c, skip_comments=True)) == "SELECT"


def test_decode_hex(spark):
    cases = {"\\x53454c": "SEL", "\\x5": "\\x5", "\\xff": "\\xff", "\\x": "", "abc": "abc", "\\xzz": "\\xzz"}
    for encoded, decoded in cases.items():
        assert one(spark, encoded, text.decode_hex_sql) == decoded
    assert one(spark, None, text.decode_hex_sql) is None


def test_decode_bytes(spark):
    for raw in (b"abc", b"a\xffb", b"\xc3", b"\xe2\x82z", b"\xf0\x9f\x98\x80"):
        assert one(spark, bytearray(raw), text.decode_bytes, "binary") == raw.decode("utf-8", "replace")


def test_marker(spark):
    row = one(spark, "/* TEST:JOIN-003:Multiple_LEFT_JOINs */\nSELECT 1", text.test_marker)
    assert tuple(row) == ("JOIN", "JOIN-003", "Multiple_LEFT_JOINs")
    assert one(spark, "SELECT 1", text.test_marker) is None


def test_anonymize(spark):
    sql = "SELECT user_id, amount FROM payments WHERE user_id = 123;"
    assert one(spark, sql, text.anonymize_sql) == "SELECT col_1, col_2 FROM table_1 WHERE col_1 = ?;"
    sql = "INSERT INTO logs (id, name) VALUES (1, 'x')"
    assert one(spark, sql, text.anonymize_sql) == "INSERT INTO table_1 (col_1, col_2) VALUES (?, ?)"
    sql = "SELECT COUNT(u.id) FROM users u JOIN orders o ON u.id = o.uid"
    assert one(spark, sql, text.anonymize_sql) == (
        "SELECT COUNT(col_1.col_2) FROM table_1 col_1 JOIN table_2 col_3 ON col_1.col_2 = col_3.col_4"
    )


def test_anonymize_plan(spark):
    sql = "SELECT user_id FROM payments WHERE user_id = 123"
    plan = '{"Plan": {"Node Type": "Seq Scan", "Relation Name": "payments", "Total Cost": 5.25, "Filter": "(user_id = 123)"}}'
    df = spark.createDataFrame([(sql, plan)], "s string, p string")
    assert df.select(text.anonymize_plan(F.col("p"), F.col("s"))).first()[0] == (
        '{"Plan": {"Node Type": "Seq Scan", "Relation Name": "table_1", "Total Cost": 5.25, "Filter": "(col_1 = ?)"}}'
    )


def test_antipatterns(spark):
    sql = "/* c */ SELECT DISTINCT * FROM a, b WHERE YEAR(x) = 1 OR y NOT IN (SELECT 1) AND z LIKE '%or'"
    assert one(spark, sql, text.antipattern_flags) == [
        "LEADING_WILDCARD", "OR_CONDITION", "NOT_IN", "SELECT_STAR", "FUNCTION_ON_COLUMN",
        "IN_SUBQUERY", "DISTINCT", "COMMA_JOIN",
    ]
    assert one(spark, "SELECT a FROM t WHERE b = ' or having '", text.antipattern_flags) == []


def test_preview(spark):
    assert one(spark, "a" * 130, text.query_preview) == "a" * 120 + "..."
    assert one(spark, "abc", text.query_preview) == "abc"
    assert one(spark, "abc", lambda c: text.query_preview(c, 80, always=True)) == "abc..."


def test_duration_label(spark):
    labels = {
        998.5: "999ms", 999.5: "1000ms", 0.5: "1ms", 1125.0: "1.13s", 1005.0: "1.00s", 59999.0: "60.00s",
        75000.0: "1.25m", 60000.0: "1.00m", 1000.0: "1.00s",
    }
    for ms, label in labels.items():
        assert one(spark, ms, measures.duration_label, "double") == label


def test_interval_to_ms(spark):
    value = datetime.timedelta(days=1, hours=2, minutes=3, seconds=4, microseconds=567891)
    assert float(one(spark, value, measures.interval_to_ms, "interval day to second")) == 93784567.891


def test_ratios_and_ranks(spark):
    df = spark.createDataFrame([(100, None), (100, 0), (0, 5), (None, 5), (7, 2)], "e long, r long")
    got = [r[0] for r in df.select(measures.efficiency_ratio(F.col("e"), F.col("r"))).collect()]
    assert got == [100.0, 100.0, None, None, 3.5]
    for level, rank in {"LOW": 1, "CRITICAL": 4, "?": 0, None: 0}.items():
        assert one(spark, level, measures.improvement_rank) == rank
    pairs = spark.createDataFrame([(10.0, 5.0), (0.0, 5.0)], "o double, n double")
    gains = [r[0] for r in pairs.select(measures.gain_ratio(F.col("o"), F.col("n"))).collect()]
    assert gains == [0.5, None]
