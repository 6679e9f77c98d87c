from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from sqltide.plans import analysis, replies, rules
from sqltide.schemas import SLOW_QUERY

AS_OF = "2024-02-01 00:00:00"
NOW = datetime.datetime(2024, 1, 15, 12)


def queries(spark, *rows):
    """Rows given as dicts over sensible defaults."""
    base = {
        "source_db_type": "mysql", "source_db_host": "h", "source_db_name": "d", "fingerprint": "f",
        "full_sql": "SELECT 1 FROM t", "sql_hash": "x", "duration_ms": Decimal("100.000"),
        "rows_examined": None, "rows_returned": None, "plan_json": None, "captured_at": NOW, "status": "NEW",
    }
    values = [{**base, "id": f"q{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(v[n] for n in SLOW_QUERY.names) for v in values], SLOW_QUERY)


def finding(spark, **row):
    return rules.dispatch_rules(queries(spark, row)).first()


def kinds(row):
    return [(s["type"], s["priority"]) for s in row["suggestions"]]


def test_default_for_unknown_database(spark):
    row = finding(spark, source_db_type="oracle", plan_json='{"a": 1}')
    assert row.problem == "Slow query detected" and row.improvement_level == "LOW"
    assert row.confidence == Decimal("0.70") and kinds(row) == [("REVIEW", "MEDIUM")]


def test_mysql_rules_in_order(spark):
    plan = (
        '{"query_block": {"table": {"table_name": "users", "access_type": "ALL", '
        '"rows_examined_per_scan": 250000}, "ordering_operation": {"using_filesort": false}}}'
    )
    row = finding(spark, plan_json=plan)
    assert row.problem == "Full table scan detected"
    assert row.root_cause.startswith("Query examines 250,000 rows. ")
    assert row.improvement_level == "HIGH" and row.confidence == Decimal("0.90")
    assert kinds(row) == [("REVIEW", "MEDIUM"), ("INDEX", "HIGH"), ("INDEX", "MEDIUM")]
    strict = rules.dispatch_rules(queries(spark, {"plan_json": plan}), strict=True).first()
    assert kinds(strict) == [("REVIEW", "MEDIUM"), ("INDEX", "HIGH")]


def test_mysql_low_is_raised_only_from_low(spark):
    many = '{"query_block": {"table": {"access_type": "ref", "rows_examined_per_scan": 100001}}}'
    few = '{"query_block": {"table": {"access_type": "ref", "rows_examined_per_scan": 100000}}}'
    assert finding(spark, plan_json=many).improvement_level == "MEDIUM"
    assert finding(spark, plan_json=few).improvement_level == "LOW"


def test_wrong_types_and_joins_do_not_fire(spark):
    text_rows = '{"query_block": {"table": {"access_type": "ref", "rows_examined_per_scan": "200000"}}}'
    nested = '{"query_block": {"nested_loop": [{"table": {"access_type": "ALL"}}]}}'
    for plan in (text_rows, nested, '{"query_block": []}', "not json"):
        assert finding(spark, plan_json=plan).improvement_level == "LOW"


def test_missing_table_name_is_unknown(spark):
    row = finding(spark, plan_json='{"query_block": {"table": {"access_type": "index"}}}')
    assert "Add index to unknown to avoid full table scan" in row["suggestions"][1]["description"]


def test_postgres_rules(spark):
    plan = '{"Plan": {"Node Type": "Seq Scan", "Relation Name": "orders", "Total Cost": 10000.125}}'
    row = finding(spark, source_db_type="postgres", plan_json=plan)
    assert row.problem == "Sequential scan detected" and "(10000.12)" in row.root_cause
    assert kinds(row) == [("REVIEW", "MEDIUM"), ("INDEX", "HIGH"), ("OPTIMIZATION", "MEDIUM")]
    assert row["suggestions"][1]["sql"] == "-- CREATE INDEX idx_orders_cols ON orders(column_name);"


def test_heuristics(spark):
    row = finding(spark, rows_examined=10000, rows_returned=1, duration_ms=Decimal("5000.001"))
    assert "10,000 rows but returns only 1 rows (ratio: 10000.0:1)" in row.root_cause
    assert row.improvement_level == "HIGH" and row.confidence == Decimal("0.80")
    assert kinds(row) == [("REVIEW", "MEDIUM"), ("INDEX", "HIGH"), ("REVIEW", "HIGH")]
    row = finding(spark, rows_examined=11, rows_returned=0)
    assert row.improvement_level == "MEDIUM" and row.confidence == Decimal("0.70")
    row = finding(spark, duration_ms=Decimal("5000.000"), plan_json="{ }")
    assert row.rule_branch == "heuristic" and row.improvement_level == "LOW"


def test_poor_ratio_without_rows_returned_fails(spark):
    q = queries(
        spark,
        {"rows_examined": 1000},
        {"rows_examined": 5},
        {"rows_examined": 1000, "status": "ANALYZED"},
        {"rows_examined": 1},
    )
    done = queries(spark, {}, {}, {}, {}).select("id").where("id = 'q3'")
    a = analysis.analyze(q.join(done, "id", "left_semi"), AS_OF)
    results = analysis.analyze_pending(q, a, AS_OF)
    assert [r.slow_query_id for r in results.collect()] == ["q1"]
    status = {r.id: r.status for r in analysis.apply_status(q, results, a).collect()}
    assert status == {"q0": "ERROR", "q1": "ANALYZED", "q2": "ANALYZED", "q3": "NEW"}


def test_own_rule(spark):
    rule = rules.Rule(
        F.col("full_sql").contains("*"), {"problem": "star"},
        rules.suggestion("BEST_PRACTICE", "LOW", "name the columns"), raises_low=True,
    )
    q = queries(spark, {"full_sql": "SELECT * FROM t"}, {})
    found = rules.dispatch_rules(q, extra={"heuristic": [rule]}).orderBy("id").collect()
    assert [r.problem for r in found] == ["star", "Slow query detected"]
    assert [r.improvement_level for r in found] == ["MEDIUM", "LOW"]


def parsed(spark, reply):
    df = spark.createDataFrame([("q0", reply)], "slow_query_id string, reply string")
    return replies.parse_ai_replies(df)


def test_reply_kinds(spark):
    full = '{"root_cause": "c", "index_recommendations": [{"sql": "S", "rationale": "R"}], "confidence": 0.9}'
    row = parsed(spark, full).first()
    assert row.root_cause == "c" and row.improvement_level == "MEDIUM" and row.confidence == 0.9
    item = row.suggestions[0]
    assert (item["type"], item["description"], item["estimated_impact"]) == ("INDEX", "R", "")
    long_text = "no json " * 200
    row = parsed(spark, long_text).first()
    assert row.ai_insights == [long_text] and row.confidence == 0.75 and row.improvement_level is None
    assert parsed(spark, '{"root_cause": "c"} trailing').first().root_cause is None
    assert parsed(spark, "[1]").first().provider == "stub"
    assert parsed(spark, None).count() == 0


def test_replies_that_do_not_fit_or_repeat(spark):
    q = queries(spark, {})
    found = analysis.rule_findings(q)
    odd = replies.merge_ai(found, parsed(spark, '{"root_cause": "c", "confidence": 95}')).first()
    assert (odd.root_cause, odd.confidence) == ("c", Decimal("0.70"))
    both = parsed(spark, '{"root_cause": "a", "confidence": 0.5}').union(parsed(spark, '{"root_cause": "b", "confidence": 0.6}'))
    assert [r.root_cause for r in replies.merge_ai(found, both.union(both)).collect()] == ["b"]


def test_plan_nodes_under_any_name(spark):
    inner = '{"table": {"table_name": "%s", "access_type": "ALL", "rows_examined_per_scan": 500000}}'
    odd = f'{{"query_block": {{"update_value_subqueries": [{inner % "a"}], "insert_from": {inner % "b"}}}}}'
    listed = '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "{[", "Plan Rows": 1e20}}]'
    q = queries(spark, {"plan_json": odd}, {"source_db_type": "postgres", "plan_json": listed}, {"plan_json": "no {json"})
    got = {(r.slow_query_id, r.table_name, r.node_rows, r.finding) for r in rules.plan_nodes(q).collect()}
    assert got == {("q0", "a", 500000, "FULL_SCAN"), ("q0", "b", 500000, "FULL_SCAN"), ("q1", "{[", None, "FULL_SCAN")}


def test_merge(spark):
    q = queries(spark, {})
    found = analysis.rule_findings(q)
    merged = replies.merge_ai(found, parsed(spark, '{"root_cause": "c"}')).first()
    assert (merged.method, merged.root_cause, merged.confidence) == ("ai_assisted", "c", Decimal("0.85"))
    assert merged.problem == "Slow query detected" and kinds(merged) == [("REVIEW", "MEDIUM")]
    hybrid = replies.merge_ai(found, replies.stub_replies(q)).first()
    assert hybrid.method == "hybrid" and len(hybrid.suggestions) == 3 and hybrid.metadata.ai_model == "mock-v1"
    assert hybrid.improvement_level == "LOW"
    alone = replies.merge_ai(found, parsed(spark, None)).first()
    assert alone.method == "rule_based" and alone.metadata.ai_provider is None


def test_plan_nodes_at_any_depth(spark):
    deep = '{"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 200000}'
    for _ in range(30):
        deep = f'{{"Node Type": "Hash Join", "Plan Rows": 1, "Plans": [{deep}]}}'
    nested = (
        '{"query_block": {"nested_loop": [{"table": {"table_name": "o", "access_type": "ALL", '
        '"rows_examined_per_scan": 1}}, {"table": {"table_name": "u", "access_type": "eq_ref"}}]}}'
    )
    q = queries(spark, {"source_db_type": "postgres", "plan_json": f'{{"Plan": {deep}}}'}, {"plan_json": nested})
    rows = rules.plan_nodes(q).collect()
    assert sum(r.slow_query_id == "q0" for r in rows) == 31
    assert [r.finding for r in rows if r.table_name == "t"] == ["FULL_SCAN"]
    assert {(r.table_name, r.node_type) for r in rows if r.slow_query_id == "q1"} == {
        ("o", "ALL"), ("u", "eq_ref"),
    }
