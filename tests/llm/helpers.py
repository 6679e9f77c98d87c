"""Small tables for the text operators."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCUMENTS):
    """One row per text, or per (id, text)."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
