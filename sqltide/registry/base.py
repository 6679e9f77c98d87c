"""Registered queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.fixtures import AS_OF, Tables
from sqltide.operators import learning
from sqltide.plans.analysis import analyze
from sqltide.schemas import FEEDBACK
from sqltide.sources.store import durable


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    oracle: str | None = None


def analyses(t: Tables) -> DataFrame:
    """Analyses of the ANALYZED queries."""
    return analyze(t.queries().where(F.col("status") == "ANALYZED"), AS_OF)


def evaluated(t: Tables) -> DataFrame:
    return learning.evaluate_effectiveness(analyses(t), t.queries())


def stored_evaluation(t: Tables) -> DataFrame:
    """The evaluation as a table, as the steps after it find it."""
    return durable(evaluated(t))


def no_feedback(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], FEEDBACK)


def feedback(t: Tables, measured: DataFrame | None = None) -> DataFrame:
    measured = evaluated(t) if measured is None else measured
    return learning.append_feedback(measured, no_feedback(t), AS_OF)


def items_text(suggestions: Column | str = "suggestions") -> Column:
    """Suggestions as one comparable string."""
    column = F.col(suggestions) if isinstance(suggestions, str) else suggestions
    return F.array_join(
        F.transform(
            column,
            lambda s: F.concat_ws(
                "|", s["type"], s["priority"], s["description"], s["sql"], s["estimated_impact"]
            ),
        ),
        ";",
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})
