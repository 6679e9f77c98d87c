"""Analysis rules: one columnar pass over all slow queries.

A rule is a condition and what it changes.  A list of rules folds, in order,
into one set of column expressions, so any number of rules costs one
projection.  The texts, levels and confidences of the rules are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.functions import measures, text
from sqltide.functions.plan_json import has_plan, plan_features, plan_node_list
from sqltide.schemas import SUGGESTION

FIELDS = (
    "problem", "root_cause", "suggestions", "improvement_level", "estimated_speedup", "confidence",
)
SUGGESTIONS_TYPE = f"array<{SUGGESTION.simpleString()}>"

# Limits beyond which the rules fire.
MANY_ROWS = 100_000
HIGH_COST = 10_000
BAD_RATIO = 100
MODERATE_RATIO = 10
URGENT_MS = 5_000


def no_suggestions() -> Column:
    return F.array().cast(SUGGESTIONS_TYPE)


def _text(value: Column | str | None) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value) if value is not None else F.lit(None).cast("string")


def suggestion(
    kind: str,
    priority: str,
    description: Column | str,
    sql: Column | str | None = None,
    estimated_impact: Column | str | None = None,
    rationale: Column | str | None = None,
) -> Column:
    values = (kind, priority, description, sql, estimated_impact, rationale)
    return F.struct(*[_text(v).alias(n) for n, v in zip(SUGGESTION.names, values, strict=True)])


def suggestions(*items: Column) -> Column:
    return F.array(*items)


@dataclass(frozen=True)
class Rule:
    """``changes`` replace fields; ``adds`` is appended; LOW may rise to MEDIUM."""

    condition: Column
    changes: Mapping[str, Column | str] = field(default_factory=dict)
    adds: Column | None = None
    raises_low: bool = False


def default_analysis() -> dict[str, Column]:
    # The finding every analysis starts from.
    return {
        "problem": F.lit("Slow query detected"),
        "root_cause": F.lit("Query execution time exceeds threshold"),
        "suggestions": suggestions(
            suggestion(
                "REVIEW", "MEDIUM", "Review query and add appropriate indexes",
                "-- Analyze query patterns and optimize", "Varies",
            )
        ),
        "improvement_level": F.lit("LOW"),
        "estimated_speedup": F.lit("2-5x"),
        "confidence": F.lit("0.70").cast("decimal(3,2)"),
    }


def fold(rules: Sequence[Rule]) -> dict[str, Column]:
    """The default finding with the rules applied in order."""
    finding = default_analysis()
    for rule in rules:
        fires = F.coalesce(rule.condition, F.lit(False))
        for name, value in rule.changes.items():
            new = _text(value)
            if name == "confidence":
                new = new.cast("decimal(3,2)")
            finding[name] = F.when(fires, new).otherwise(finding[name])
        if rule.raises_low:
            level = finding["improvement_level"]
            finding["improvement_level"] = F.when(
                fires & (level == "LOW"), F.lit("MEDIUM")
            ).otherwise(level)
        if rule.adds is not None:
            extra = F.when(fires, suggestions(rule.adds)).otherwise(no_suggestions())
            finding["suggestions"] = F.concat(finding["suggestions"], extra)
    return finding


def _grouped(value: Column) -> Column:
    """Thousands separators; decimals only when the value has some."""
    return F.call_function("format_number", value, F.lit("#,##0.###############"))


def mysql_plan_rules(plan: Column, strict: bool = False) -> list[Rule]:
    """Rules on the single-table block of a MySQL plan.

    ``strict`` tests the filesort value; without it the mere mention counts.
    """
    access, rows = plan["access_type"], plan["rows_examined_per_scan"]
    table = F.coalesce(plan["table_name"], F.lit("unknown"))
    return [
        Rule(
            access.isin("ALL", "index"),
            {
                "problem": "Full table scan detected",
                "root_cause": F.concat(
                    F.lit("Query is performing a full table scan (access_type: "), access,
                    F.lit("). This means every row in the table is being examined, "
                          "which is very slow for large tables."),
                ),
                "improvement_level": "HIGH",
                "estimated_speedup": "10-100x",
                "confidence": "0.90",
            },
            suggestion(
                "INDEX", "HIGH",
                F.concat(F.lit("Add index to "), table, F.lit(" to avoid full table scan")),
                F.concat(F.lit("-- Analyze query and add appropriate index on "), table),
                "10-100x improvement",
            ),
        ),
        Rule(
            plan["uses_filesort"] if strict else plan["has_filesort"],
            adds=suggestion(
                "INDEX", "MEDIUM", "Add index to avoid filesort operation",
                "-- Add index on ORDER BY columns", "2-5x improvement",
            ),
            raises_low=True,
        ),
        Rule(
            rows > MANY_ROWS,
            {
                "root_cause": F.concat(
                    F.lit("Query examines "), _grouped(rows),
                    F.lit(" rows. This indicates missing or ineffective indexes."),
                )
            },
            raises_low=True,
        ),
    ]


def postgres_plan_rules(plan: Column) -> list[Rule]:
    """Rules on the root node of a PostgreSQL plan."""
    table, cost = F.coalesce(plan["relation_name"], F.lit("unknown")), plan["total_cost"]
    return [
        Rule(
            plan["node_type"] == "Seq Scan",
            {
                "problem": "Sequential scan detected",
                "root_cause": F.concat(
                    F.lit("Query is performing a sequential scan on "), table,
                    F.lit(". PostgreSQL is reading every row in the table sequentially, "
                          "which is slow for large tables."),
                ),
                "improvement_level": "HIGH",
                "estimated_speedup": "10-100x",
                "confidence": "0.90",
            },
            suggestion(
                "INDEX", "HIGH",
                F.concat(F.lit("Add index to "), table, F.lit(" to enable index scan")),
                F.concat(
                    F.lit("-- CREATE INDEX idx_"), table, F.lit("_cols ON "), table,
                    F.lit("(column_name);"),
                ),
                "10-100x improvement",
            ),
        ),
        Rule(
            cost > HIGH_COST,
            {
                "root_cause": F.concat(
                    F.lit("Query has high execution cost estimate ("),
                    measures.plain_number(cost, 2),
                    F.lit("). This usually indicates inefficient query structure "
                          "or missing indexes."),
                )
            },
            suggestion(
                "OPTIMIZATION", "MEDIUM", "Review query structure and consider query rewrite",
                "-- Consider breaking down complex query or adding indexes", "2-10x improvement",
            ),
            raises_low=True,
        ),
    ]


def heuristic_rules(examined: Column, returned: Column, duration_ms: Column) -> list[Rule]:
    """Rules on the row counts and the duration, for queries without a plan."""
    ratio = measures.efficiency_ratio(examined, returned)
    examined_text, returned_text = F.format_number(examined, 0), F.format_number(returned, 0)
    return [
        Rule(
            ratio > BAD_RATIO,
            {
                "problem": "Inefficient query: examining too many rows",
                "root_cause": F.concat(
                    F.lit("Query examines "), examined_text, F.lit(" rows but returns only "),
                    returned_text, F.lit(" rows (ratio: "), measures.plain_number(ratio, 1),
                    F.lit(":1). This suggests missing or ineffective indexes."),
                ),
                "improvement_level": "HIGH",
                "estimated_speedup": "10-50x",
                "confidence": "0.80",
            },
            suggestion(
                "INDEX", "HIGH", "Add indexes to reduce rows examined",
                "-- Analyze WHERE clauses and add appropriate indexes", "10-50x improvement",
            ),
        ),
        Rule(
            (ratio > MODERATE_RATIO) & (ratio <= BAD_RATIO),
            {
                "problem": "Moderate inefficiency in row scanning",
                "root_cause": F.concat(
                    F.lit("Query examines "), examined_text, F.lit(" rows to return "),
                    returned_text,
                    F.lit(" rows. Consider adding indexes to narrow down the scan."),
                ),
                "improvement_level": "MEDIUM",
                "estimated_speedup": "2-10x",
            },
            suggestion(
                "INDEX", "MEDIUM", "Consider adding indexes to improve filtering",
                "-- Review WHERE clauses and add selective indexes", "2-10x improvement",
            ),
        ),
        Rule(
            duration_ms > URGENT_MS,
            adds=suggestion(
                "REVIEW", "HIGH",
                "Query takes more than 5 seconds - requires urgent optimization",
                "-- Consider query rewrite, partitioning, or caching",
                "Critical performance issue",
            ),
            raises_low=True,
        ),
    ]


def _node_facts(node: Column) -> Column:
    """What the findings look at, under one name for both kinds of plan."""
    kind = F.coalesce(node["access_type"], node["Node Type"])
    rows = F.coalesce(node["rows_examined_per_scan"], node["Plan Rows"])
    sorts = F.coalesce(node["using_filesort"], F.lit(False)) | F.coalesce(
        node["using_temporary_table"], F.lit(False)
    )
    return F.struct(
        kind.alias("kind"),
        F.coalesce(node["table_name"], node["Relation Name"]).alias("table_name"),
        rows.alias("rows"),
        F.when(kind.isin("ALL", "index", "Seq Scan") & (rows > MANY_ROWS), F.lit("FULL_SCAN"))
        .when((kind == "Nested Loop") & (rows > MANY_ROWS), F.lit("LARGE_NESTED_LOOP"))
        .when(sorts | (kind == "Sort"), F.lit("SORT_OR_TEMPORARY"))
        .alias("finding"),
    )


def plan_facts(plan_json: Column) -> Column:
    """The facts and findings of all nodes of a plan, as an array, the outer ones first."""
    return F.transform(plan_node_list(plan_json), _node_facts)


def node_rules(nodes: Column, root_table: Column, known_sort: Column) -> list[Rule]:
    """Rules on the nodes below a plan's root: joins, nested loops, sorts and temporary tables.

    The root itself is left to the plan rules: a scan of ``root_table`` and a
    sort that they have named already (``known_sort``) are not told twice.  Of
    several scans the one with the most rows is named, of equals the outermost.
    """
    of = lambda finding: F.filter(nodes, lambda n: n["finding"] == finding)
    scans = F.filter(of("FULL_SCAN"), lambda n: ~n["table_name"].eqNullSafe(root_table))
    most = F.array_max(F.transform(scans, lambda n: n["rows"]))
    scan = F.get(F.filter(scans, lambda n: n["rows"] == most), F.lit(0))
    table = F.coalesce(scan["table_name"], F.lit("unknown"))
    loops = of("LARGE_NESTED_LOOP")
    # MySQL names no loop: a join that reads its first table many times over is one.
    tables = F.filter(nodes, lambda n: n["table_name"].isNotNull())
    joined = F.size(F.array_distinct(F.transform(tables, lambda n: n["table_name"]))) > 1
    return [
        Rule(
            F.size(scans) > 0,
            {
                "problem": "Full table scan inside a join",
                "root_cause": F.concat(
                    F.lit("The plan reads all of "), table, F.lit(" ("), _grouped(scan["rows"]),
                    F.lit(" rows, "), scan["kind"], F.lit(") below its root."),
                ),
                "improvement_level": "HIGH",
                "estimated_speedup": "10-100x",
                "confidence": "0.85",
            },
            suggestion(
                "INDEX", "HIGH",
                F.concat(F.lit("Add index to "), table, F.lit(" on the columns of its filter")),
                F.concat(F.lit("-- CREATE INDEX ON "), table, F.lit(" (filter columns)")),
                "10-100x improvement",
            ),
        ),
        Rule(
            (F.size(loops) > 0) | ((F.size(scans) > 0) & joined),
            adds=suggestion(
                "INDEX", "HIGH", "Add indexes on the join columns of the nested loop",
                "-- Add index on the inner table's join column", "5-50x improvement",
            ),
            raises_low=True,
        ),
        Rule(
            (F.size(of("SORT_OR_TEMPORARY")) > 0) & ~F.coalesce(known_sort, F.lit(False)),
            adds=suggestion(
                "INDEX", "MEDIUM", "Add index on the sort columns to avoid a sort or temporary table",
                "-- Add index on ORDER BY or GROUP BY columns", "2-5x improvement",
            ),
            raises_low=True,
        ),
    ]


def dispatch_rules(
    q: DataFrame,
    strict: bool = False,
    extra: Mapping[str, Sequence[Rule]] | None = None,
) -> DataFrame:
    """Adds ``rule_branch``, ``analysis_failed`` and the finding to every query.

    Plans are looked at whole: first the rules on the root, then those on the
    nodes below it, all in one projection.  ``extra`` appends user rules per
    branch: mysql, postgres, other, heuristic.
    """
    extra = extra or {}
    planned = has_plan(F.col("plan_json"))
    known = planned & F.col("source_db_type").isin("mysql", "postgres")
    # A plan with one bracket pair inside another, a root and its table, has no nodes below.
    below = known & (F.length(F.regexp_replace(F.col("plan_json"), r"[^{]++", "")) > 2)
    q = q.withColumns(
        {
            "_plan": F.when(planned, plan_features(F.col("plan_json"), F.col("source_db_type"))),
            "_nodes": F.when(below, plan_facts(F.col("plan_json"))),
        }
    ).withColumn(
        "rule_branch",
        F.when(~planned, F.lit("heuristic"))
        .when(F.col("source_db_type").isin("mysql", "postgres"), F.col("source_db_type"))
        .otherwise(F.lit("other")),
    )
    examined, returned = F.col("rows_examined"), F.col("rows_returned")
    plan, nodes = F.col("_plan"), F.col("_nodes")
    filesort = plan["uses_filesort"] if strict else plan["has_filesort"]
    seq_scan = F.when(plan["node_type"] == "Seq Scan", plan["relation_name"])
    findings = {
        "mysql": fold(
            [
                *mysql_plan_rules(plan, strict),
                *node_rules(nodes, plan["table_name"], filesort),
                *extra.get("mysql", ()),
            ]
        ),
        "postgres": fold(
            [
                *postgres_plan_rules(plan),
                *node_rules(nodes, seq_scan, F.lit(False)),
                *extra.get("postgres", ()),
            ]
        ),
        "other": fold(extra.get("other", ())),
        "heuristic": fold(
            [
                *heuristic_rules(examined, returned, F.col("duration_ms")),
                *extra.get("heuristic", ()),
            ]
        ),
    }
    branch = F.col("rule_branch")
    merged = {}
    for name in FIELDS:
        choice = findings["heuristic"][name]
        for key in ("mysql", "postgres", "other"):
            choice = F.when(branch == key, findings[key][name]).otherwise(choice)
        merged[name] = choice
    # Writing the message of a poor ratio needs the rows returned.
    failed = (
        (branch == "heuristic")
        & (measures.efficiency_ratio(examined, returned) > MODERATE_RATIO)
        & returned.isNull()
    )
    return (
        q.withColumn("analysis_failed", F.coalesce(failed, F.lit(False)))
        .withColumns(merged)
        .withColumn("tables", text.extract_tables(text.decode_hex_sql(F.col("full_sql"))))
        .drop("_plan", "_nodes")
    )


def plan_nodes(q: DataFrame) -> DataFrame:
    """One row per table access or PostgreSQL plan node, at any depth, with findings."""
    nodes = q.where(has_plan(F.col("plan_json"))).select(
        F.col("id").alias("slow_query_id"),
        "source_db_type",
        F.posexplode(plan_facts(F.col("plan_json"))).alias("node_no", "node"),
    )
    return nodes.select(
        "slow_query_id",
        "source_db_type",
        "node_no",
        F.col("node.kind").alias("node_type"),
        F.col("node.table_name").alias("table_name"),
        F.col("node.rows").try_cast("bigint").alias("node_rows"),
        F.col("node.finding").alias("finding"),
    ).where(F.col("node_type").isNotNull() | F.col("finding").isNotNull())
