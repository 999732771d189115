"""Each query of the core against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from talea.plans import telemetry
from tests.compare import same

QUERIES = {k: v for m in entry.CORE for k, v in m.QUERIES.items()}
SQL = {k: v for m in entry.CORE for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_topk_ranks_every_scrape(spark, data):
    scrapes = {r.t for r in telemetry.telemetry.rate(telemetry._samples(spark, data), telemetry.LABELS, 3600).select("t").distinct().collect()}
    assert {r.t for r in QUERIES["topk_series_all"](spark, data).where("place = 1").collect()} == scrapes


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
