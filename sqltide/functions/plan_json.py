"""EXPLAIN-plan functions: root features and the walk over all plan nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.functions.text import let

_ROOT = T.StructType(
    [
        T.StructField(
            "query_block",
            T.StructType(
                [
                    T.StructField(
                        "table",
                        T.StructType(
                            [
                                T.StructField("access_type", T.StringType()),
                                T.StructField("table_name", T.StringType()),
                                T.StructField("rows_examined_per_scan", T.DoubleType()),
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField(
            "Plan",
            T.StructType(
                [
                    T.StructField("Node Type", T.StringType()),
                    T.StructField("Relation Name", T.StringType()),
                    T.StructField("Total Cost", T.DoubleType()),
                ]
            ),
        ),
    ]
)

# The facts of a plan object that the findings look at.
_FACTS = {
    "table_name": "string",
    "access_type": "string",
    "rows_examined_per_scan": "double",
    "using_filesort": "boolean",
    "using_temporary_table": "boolean",
    "Node Type": "string",
    "Relation Name": "string",
    "Plan Rows": "double",
}


def has_plan(plan_json: Column) -> Column:
    """An empty plan counts as no plan."""
    text = F.regexp_replace(F.coalesce(plan_json, F.lit("")), r"\s", "")
    return ~text.isin("", "{}", "[]", "null")


def plan_features(plan_json: Column, db_type: Column) -> Column:
    """Struct of the root facts the plan rules look at.

    A value of the wrong JSON type is read as missing.
    """
    root = F.from_json(plan_json, _ROOT)
    mysql, postgres = db_type == "mysql", db_type == "postgres"
    table, node = root["query_block"]["table"], root["Plan"]
    block = F.get_json_object(plan_json, "$.query_block")
    return F.struct(
        F.when(mysql, table["access_type"]).alias("access_type"),
        F.when(mysql, table["table_name"]).alias("table_name"),
        F.when(mysql, table["rows_examined_per_scan"]).alias("rows_examined_per_scan"),
        F.when(mysql, F.coalesce(F.lower(block).contains("filesort"), F.lit(False))).alias(
            "has_filesort"
        ),
        F.when(
            mysql, block.rlike(r'"using_filesort"\s*:\s*true')
        ).alias("uses_filesort"),
        F.when(postgres, node["Node Type"]).alias("node_type"),
        F.when(postgres, node["Relation Name"]).alias("relation_name"),
        F.when(postgres, node["Total Cost"]).alias("total_cost"),
    )


def _opened(value: Column) -> Column:
    """A value as a map of its members or as a list of its items; both null for anything else.

    Each value is cast once by kind; the casts of the other kinds give null at once.
    """
    return let(
        F.try_variant_get(value, "$", "map<string,variant>"),
        lambda members: F.struct(
            members.alias("members"),
            F.when(members.isNull(), F.try_variant_get(value, "$", "array<variant>")).alias("items"),
        ),
    )


def _inside(opened: Column) -> Column:
    none = F.array().cast("array<variant>")
    return F.coalesce(F.map_values(opened["members"]), opened["items"], none)


def plan_node_list(plan_json: Column) -> Column:
    """Every plan object at any depth, as an array of structs, the outer ones first.

    Children are found by being objects or lists, not by their names.  The plan
    is parsed once and walked level by level inside one expression until a level
    holds no objects or lists; there are never more levels than brackets.
    """
    root = F.array_compact(F.array(F.try_parse_json(plan_json)))
    nested = lambda values: F.filter(
        F.transform(values, _opened), lambda o: o["members"].isNotNull() | o["items"].isNotNull()
    )

    def next_level(state: Column, _: Column) -> Column:
        found = nested(F.flatten(F.transform(state["frontier"], _inside)))
        further = let(
            found,
            lambda level: F.struct(level.alias("frontier"), F.concat(state["seen"], level).alias("seen")),
        )
        return F.when(F.size(state["frontier"]) == 0, state).otherwise(further)

    start = let(nested(root), lambda level: F.struct(level.alias("frontier"), level.alias("seen")))
    brackets = F.length(F.regexp_replace(plan_json, r"[^{\[]++", ""))
    levels = F.sequence(F.lit(1), F.greatest(brackets, F.lit(1)))
    nodes = F.aggregate(levels, start, next_level, lambda s: s["seen"])
    objects = F.filter(nodes, lambda o: o["members"].isNotNull())
    return F.transform(
        objects,
        lambda o: F.struct(
            *[
                F.try_variant_get(F.element_at(o["members"], name), "$", kind).alias(name)
                for name, kind in _FACTS.items()
            ]
        ),
    )
