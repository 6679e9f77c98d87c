"""All registered queries, in the order of the operator inventory."""

from __future__ import annotations

from sqltide.registry import analysis, collect, knowledge, lab, statistics, streams, texts
from sqltide.registry.base import Entry

ENTRIES: dict[str, Entry] = {
    **collect.ENTRIES,
    **texts.ENTRIES,
    **statistics.ENTRIES,
    **analysis.ENTRIES,
    **knowledge.ENTRIES,
    **streams.ENTRIES,
    **lab.ENTRIES,
}
