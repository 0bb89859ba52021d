"""Every SQL-checked query (models excluded, see test_models.py) against DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from signals.sources.adapters import DRIVER_TABLES

SF_SMALL = "/root/testdata/sf0.001"

MODEL_KEYS = {"kmeans_fit", "select_optimal_k", "fit_clusters", "train_readiness", "cross_validate_r2",
              "feature_importance", "top_importance", "shap_values", "score_portfolio", "score_portfolio_invariants"}
KEYS = [k for k in E.oracle_sql() if k not in MODEL_KEYS]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def normalise(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def test_every_query_has_a_check():
    assert set(E.queries()) >= set(E.oracle_sql())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    scols, srows = normalise(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    dcols, drows = normalise([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "recommended_outcome" in df.columns
