"""Model replies, read from a table, and their merge with the rule findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.operators.dedup import first_per_key
from sqltide.plans.rules import SUGGESTIONS_TYPE, no_suggestions, suggestion, suggestions

_STR = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, _STR) for name in names])


REPLY = T.StructType(
    [
        T.StructField("root_cause", _STR),
        T.StructField("problem_summary", _STR),
        T.StructField("index_recommendations", T.ArrayType(_strings("sql", "rationale", "impact"))),
        T.StructField(
            "query_optimizations", T.ArrayType(_strings("type", "description", "example"))
        ),
        T.StructField("improvement_level", _STR),
        T.StructField("estimated_speedup", _STR),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# What a plain-text reply and a missing confidence are worth.
TEXT_CONFIDENCE = 0.75
REPLY_CONFIDENCE = 0.85


def _json_kind(boxed: Column) -> Column:
    """'object', 'other' for any other JSON value, or 'text' when it is no JSON."""
    first = F.try_variant_get(boxed, "$[0]", "variant")
    second = F.try_variant_get(boxed, "$[1]", "variant")
    return (
        F.when(boxed.isNull() | first.isNull() | second.isNotNull(), F.lit("text"))
        .when(F.schema_of_variant(first).startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("other"))
    )


def parse_ai_replies(
    replies: DataFrame,
    provider: str = "openai",
    model: str = "gpt-4",
    insight_length: int | None = None,
) -> DataFrame:
    """Replies (slow_query_id, reply) to the common shape.

    A JSON object is read field by field.  Text that is no JSON is kept as an
    insight, whole unless ``insight_length`` cuts it.  JSON of another kind
    falls back to the stub reply.
    """
    return _parsed(replies.where(F.col("reply").isNotNull()), ["slow_query_id"], provider, model, insight_length)


def _parsed(
    replies: DataFrame,
    keep: Sequence[str],
    provider: str = "openai",
    model: str = "gpt-4",
    insight_length: int | None = None,
) -> DataFrame:
    """The columns ``keep`` and those of the reply in the common shape."""
    # Inside brackets, text after the first value no longer goes unnoticed.
    boxed = F.try_parse_json(F.concat(F.lit("["), "reply", F.lit("]")))
    staged = (
        replies.select(*keep, "reply", F.from_json("reply", REPLY).alias("_r"), boxed.alias("_boxed"))
        .withColumn("_kind", _json_kind(F.col("_boxed")))
    )
    r, blank = F.col("_r"), F.lit("")
    is_object, is_text = F.col("_kind") == "object", F.col("_kind") == "text"
    from_indexes = F.transform(
        F.coalesce(r["index_recommendations"], F.array().cast(REPLY["index_recommendations"].dataType)),
        lambda x: suggestion(
            "INDEX", "HIGH", F.coalesce(x["rationale"], blank), F.coalesce(x["sql"], blank),
            F.coalesce(x["impact"], blank),
        ),
    )
    from_rewrites = F.transform(
        F.coalesce(r["query_optimizations"], F.array().cast(REPLY["query_optimizations"].dataType)),
        lambda x: suggestion(
            "OPTIMIZATION", "MEDIUM", F.coalesce(x["description"], blank),
            F.coalesce(x["example"], blank), "Varies",
        ),
    )
    own = F.concat(from_indexes, from_rewrites).cast(SUGGESTIONS_TYPE)
    said = F.col("reply") if insight_length is None else F.substring("reply", 1, insight_length)
    insights = F.when(is_text, F.array(said))
    parsed = staged.select(
        *keep,
        "_kind",
        F.when(is_object, F.coalesce(r["root_cause"], blank)).alias("root_cause"),
        F.when(is_object, F.coalesce(r["problem_summary"], blank)).alias("problem"),
        F.when(is_object, own).otherwise(no_suggestions()).alias("suggestions"),
        F.when(is_object, F.coalesce(r["improvement_level"], F.lit("MEDIUM"))).alias(
            "improvement_level"
        ),
        F.when(is_object, F.coalesce(r["estimated_speedup"], F.lit("2-5x"))).alias(
            "estimated_speedup"
        ),
        F.coalesce(insights, F.array().cast("array<string>")).alias("ai_insights"),
        no_suggestions().alias("additional_suggestions"),
        F.when(is_object, F.coalesce(r["confidence"], F.lit(REPLY_CONFIDENCE)))
        .otherwise(F.lit(TEXT_CONFIDENCE))
        .alias("confidence"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
    )
    stub = stub_reply()
    other = F.col("_kind") == "other"
    return parsed.select(
        *keep,
        "root_cause",
        "problem",
        "suggestions",
        "improvement_level",
        "estimated_speedup",
        *[
            F.when(other, stub[name]).otherwise(F.col(name)).alias(name)
            for name in ("ai_insights", "additional_suggestions", "confidence", "provider", "model")
        ],
    )


def stub_reply() -> dict[str, Column]:
    """The reply used when no model answers."""
    # The stub's insights and suggestions.
    return {
        "root_cause": F.lit(None).cast("string"),
        "problem": F.lit(None).cast("string"),
        "suggestions": no_suggestions(),
        "improvement_level": F.lit(None).cast("string"),
        "estimated_speedup": F.lit(None).cast("string"),
        "ai_insights": F.array(
            F.lit("This query could benefit from proper indexing"),
            F.lit("Consider analyzing the WHERE clause conditions"),
            F.lit("Review if all columns in SELECT are necessary"),
        ),
        "additional_suggestions": suggestions(
            suggestion(
                "BEST_PRACTICE", "LOW", "Use specific column names instead of SELECT *",
                rationale="Reduces network overhead and improves query cache efficiency",
            ),
            suggestion(
                "MONITORING", "LOW", "Set up query performance monitoring",
                rationale="Track query performance over time to detect regressions",
            ),
        ),
        "confidence": F.lit(0.75),
        "provider": F.lit("stub"),
        "model": F.lit("mock-v1"),
    }


def stub_replies(q: DataFrame) -> DataFrame:
    """The stub reply for every query, in the common shape."""
    return q.select(
        F.col("id").alias("slow_query_id"),
        *[value.alias(name) for name, value in stub_reply().items()],
    )


def merge_ai(rules: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rule findings with the parsed replies laid over them.

    A query without a reply keeps its rule-based finding.  Of several replies to
    one query the one with the highest confidence counts, then the least by
    its fields.  A confidence that does not fit the column is not taken over.
    """
    names = [c for c in parsed.columns if c != "slow_query_id"]
    ai = first_per_key(parsed, ["slow_query_id"], _best_reply(names)).select(
        "slow_query_id",
        F.struct(*names).alias("ai"),
    )
    return laid_over(rules.join(ai, "slow_query_id", "left"))


def _best_reply(names: Sequence[str]) -> list[Column]:
    return [F.col("confidence").desc_nulls_last(), F.struct(*sorted(c for c in names if c != "confidence"))]


def with_best_reply(rows: DataFrame) -> DataFrame:
    """One row per id of queries with a ``reply`` each: the best reply, parsed, in ``ai``, null where there is none."""
    own = [F.col(c).alias(f"_own_{c}") for c in rows.columns if c != "reply"]
    keep = [f"_own_{c}" for c in rows.columns if c != "reply"]
    parsed = _parsed(rows.select(*own, "reply"), [*keep, "reply"])
    names = [c for c in parsed.columns if c not in keep and c != "reply"]
    best = first_per_key(parsed, ["_own_id"], [F.col("reply").isNull(), *_best_reply(names)])
    ai = F.when(F.col("reply").isNotNull(), F.struct(*names))
    return best.select(*[F.col(c).alias(c.removeprefix("_own_")) for c in keep], ai.alias("ai"))


def laid_over(joined: DataFrame) -> DataFrame:
    """Rule findings with the parsed reply in ``ai`` laid over them."""
    reply = F.col("ai")
    answered = reply.isNotNull()
    has_cause = F.coalesce(reply["root_cause"], F.lit("")) != ""
    has_own = F.coalesce(F.size(reply["suggestions"]), F.lit(0)) > 0
    trusted = F.coalesce(reply["confidence"], F.lit(0.0)) > 0
    base = F.when(has_own, reply["suggestions"]).otherwise(F.col("suggestions"))
    none = F.array().cast("array<string>")

    def prefer(name: str) -> Column:
        return F.coalesce(F.nullif(reply[name], F.lit("")), F.col(name)).alias(name)

    return joined.select(
        "slow_query_id",
        prefer("problem"),
        prefer("root_cause"),
        F.concat(base, F.coalesce(reply["additional_suggestions"], no_suggestions())).alias(
            "suggestions"
        ),
        F.coalesce(reply["improvement_level"], F.col("improvement_level")).alias(
            "improvement_level"
        ),
        F.coalesce(reply["estimated_speedup"], F.col("estimated_speedup")).alias(
            "estimated_speedup"
        ),
        F.coalesce(
            F.when(trusted, F.round(reply["confidence"], 2).try_cast("decimal(3,2)")),
            F.col("confidence"),
        ).alias("confidence"),
        F.when(has_cause, F.lit("ai_assisted"))
        .when(trusted, F.lit("hybrid"))
        .otherwise(F.col("method"))
        .alias("method"),
        F.struct(
            F.col("metadata.tables").alias("tables"),
            F.when(answered, F.coalesce(reply["ai_insights"], none)).alias("ai_insights"),
            F.when(answered, F.coalesce(reply["provider"], F.lit("stub"))).alias("ai_provider"),
            F.when(answered, F.coalesce(reply["model"], F.lit("unknown"))).alias("ai_model"),
        ).alias("metadata"),
    )
