"""Small tables for the operator tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts, ids=None, langs=None) -> DataFrame:
    """A documents table; ids default to 0, 1, 2, ..."""
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS)


def rows(df: DataFrame, *cols) -> list[tuple]:
    """Sorted rows, nulls first."""
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))
