"""Small tables with awkward rows, and plain-Python rows of results."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, `copy` string, _id string"


def docs(spark, texts, **more):
    """Documents with extra columns whose names clash with outputs; ids count from 0 unless given."""
    ids = more.get("ids") or list(range(len(texts)))
    langs = more.get("langs") or ["en"] * len(texts)
    sources = more.get("sources") or ["s"] * len(texts)
    rows = [(i, t, g, s, None if t is None else len(t), "f", "c", "x") for i, t, g, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, DOC_SCHEMA).drop("copy").drop("_id") if more.get("plain") else spark.createDataFrame(rows, DOC_SCHEMA)


def rows(df, *cols):
    return [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
