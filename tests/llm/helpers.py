"""Small frames with the awkward rows that every operator must stand."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def docs(spark, texts, ids=None, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "a", None if t is None else len(t))
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \t\n", "x", "é漢🙂 \x1c\x85\u00a0 ok", "word " * 30_000, "a" * 50_000, "same text here", "same text here",
           "line one\nline one\nline one", "0123 !!! ###"]


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def same_as_sql(spark, key, sf=SF):
    """Whether a registered query and its SQL give the same rows."""
    from signals.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[key](spark, sf)
    res = con.execute(ORACLES[key])
    want = normal([d[0] for d in res.description], res.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    return got == want
