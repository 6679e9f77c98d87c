"""Every registered query against its oracle, and its plan."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as registered
from conftest import SMALL
from oracle_check import differences
from sqltide.registry import ENTRIES

QUERIES, ORACLES = registered.queries(), registered.oracle_sql()
# Plans that would not hold at scale: row-at-a-time Python, all pairs.
FORBIDDEN = re.compile(
    r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin"
)


def executed(spark, after=-1):
    """(number, plan) of every query that has run since, those of stages before a checkpoint included."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    every = [runs.apply(i) for i in range(runs.size())]
    return [(r.executionId(), r.physicalPlanDescription()) for r in every if r.executionId() > after]


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_matches_oracle(spark, duck, name):
    last = max((number for number, _ in executed(spark)), default=-1)
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0
    plans = [plan for _, plan in executed(spark, last)]
    assert plans
    for plan in plans:
        assert not FORBIDDEN.search(plan), plan


def test_entry_has_rows(spark):
    assert registered.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("gone", ["sqltide.llm", "corpus_pipeline", "public_tokenizers", "pandas"])
def test_entry_goes_without_the_text_operators(gone):
    """The other queries are there when the text operators, or what only they need, are not."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {gone!r} or name.startswith({gone + '.'!r}):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as entry\n"
        "names = entry.queries()\n"
        "assert 'pattern_summary' in names and 'op1_token_counts' not in names and 'pipeline' not in names\n"
    )
    root = os.path.dirname(os.path.abspath(registered.__file__))
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
