"""Predicate antipatterns, each with statements that have it and statements that do not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sqltide.functions import predicates

FLAGS = {
    "SELECT a FROM t WHERE price * 2 > 100": ["MATH_ON_COLUMN"],
    "SELECT a FROM t WHERE 10 + t.price = 5": ["MATH_ON_COLUMN"],
    "SELECT a FROM t WHERE x = y - 1": ["MATH_ON_COLUMN"],
    "SELECT a FROM t WHERE price > 100 * 2": [],
    "SELECT price * 2 FROM t WHERE price > 1": [],
    "SELECT a FROM t WHERE price > -5": [],
    "SELECT count(*) FROM t WHERE b = 1": [],
    "SELECT a FROM t WHERE note = 'x * 2 = 3'": [],
    "UPDATE t SET n = n + 1 WHERE id = 3": [],
    "SELECT * FROM a JOIN b": ["JOIN_WITHOUT_CONDITION"],
    "SELECT * FROM a, b WHERE a.x = 1": ["JOIN_WITHOUT_CONDITION"],
    "SELECT * FROM a JOIN b ON a.id = b.id, c": ["JOIN_WITHOUT_CONDITION"],
    "SELECT * FROM a JOIN b ON a.id = b.aid": [],
    "SELECT * FROM a, b WHERE a.id = b.aid": [],
    "SELECT * FROM a JOIN b USING (id)": [],
    "SELECT * FROM a CROSS JOIN b": [],
    "SELECT x, y FROM a WHERE x IN (1, 2)": [],
    "SELECT * FROM a JOIN (SELECT id, n FROM c) d ON d.id = a.id": [],
    "": [],
}
USERS = {"id": "bigint(20)", "name": "varchar(80)", "born": "date", "city": "text"}
ORDERS = {"id": "int", "user_id": "INT", "code": "char(8)", "price": "decimal(10,2)", "at": "timestamp without time zone"}
TYPES = {
    "SELECT * FROM orders WHERE code = 17": ["TYPE_TEXT_NUMBER"],
    "SELECT * FROM orders o WHERE o.price > '100'": ["TYPE_TEXT_NUMBER"],
    "SELECT * FROM orders WHERE '7' = user_id": ["TYPE_TEXT_NUMBER"],
    "SELECT * FROM orders WHERE code = 'x17'": [],
    "SELECT * FROM orders WHERE price > 100": [],
    "SELECT * FROM users u JOIN orders o ON u.name = o.user_id": ["TYPE_JOIN_MISMATCH"],
    "SELECT * FROM users AS u JOIN shop.orders o ON u.id = o.user_id": [],
    "SELECT * FROM users WHERE born >= '2000-01-01'": ["TYPE_DATE_TEXT"],
    "SELECT * FROM orders WHERE orders.at < '2024-01-01' AND code = 5": ["TYPE_DATE_TEXT", "TYPE_TEXT_NUMBER"],
    "SELECT * FROM users WHERE born >= DATE '2000-01-01'": [],
    "SELECT * FROM orders WHERE price LIKE '10%'": ["TYPE_LIKE_ON_NUMBER"],
    "SELECT * FROM orders WHERE price NOT LIKE '10%'": ["TYPE_LIKE_ON_NUMBER"],
    "SELECT * FROM users WHERE name LIKE 'A%'": [],
    "SELECT * FROM users, orders WHERE id = '5'": [],  # both have an id
    "SELECT * FROM elsewhere WHERE price = '5'": [],
    "SELECT * FROM orders WHERE missing = '5'": [],
    "SELECT name FROM users WHERE id IN (SELECT user_id FROM orders o WHERE o.code = 3)": ["TYPE_TEXT_NUMBER"],
    "": [],
}


@pytest.fixture(scope="module")
def flagged(spark):
    df = spark.createDataFrame([(s,) for s in FLAGS], "s string")
    return {r.s: r.f for r in df.select("s", predicates.predicate_flags(F.col("s")).alias("f")).collect()}


@pytest.mark.parametrize("sql", list(FLAGS))
def test_predicate_flags(flagged, sql):
    assert flagged[sql] == FLAGS[sql]


def test_null_statement(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(predicates.predicate_flags(F.col("s"))).first()[0] == []


@pytest.fixture(scope="module")
def typed(spark):
    source = ("mysql", "h", "shop")
    rows = [(*source, t, c, k) for t, cols in (("users", USERS), ("orders", ORDERS)) for c, k in cols.items()]
    columns = spark.createDataFrame(
        rows, "source_db_type string, source_db_host string, source_db_name string, table_name string, "
        "column_name string, data_type string"
    )
    q = spark.createDataFrame(
        [(s, *source, s) for s in TYPES] + [("other db", "mysql", "h", "x", "SELECT * FROM orders WHERE code = 17"), ("null", *source, None)],
        "id string, source_db_type string, source_db_host string, source_db_name string, full_sql string",
    )
    return {r.id: r.flags for r in predicates.type_flags(q, columns).collect()}


@pytest.mark.parametrize("sql", list(TYPES))
def test_type_flags(typed, sql):
    assert typed[sql] == TYPES[sql]


def test_columns_of_another_database(typed):
    assert typed["other db"] == typed["null"] == []
    assert len(typed) == len(TYPES) + 2
