"""Every query against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

from lumaframe.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
