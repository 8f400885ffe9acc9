"""Every registered query of the engine against its SQL; the rest must give rows of a stable schema."""

import pytest
from compare import rows, views

from ledgerlens.plans import catalog, lanes, ledgers, lives, more, upkeep  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, name):
    found = catalog.QUERIES[name](spark, small)
    assert len(set(found.columns)) == len(found.columns)
    got = found.toPandas()
    if name not in catalog.ORACLE_SQL:
        assert list(got.columns) == found.columns
        return
    want = views(small).execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_list_count_and_histogram_agree(spark, small):
    one = lambda n: catalog.QUERIES[n](spark, small)
    timed = one("export_json").count() - one("histogram_hour").agg({"calls": "sum"}).first()[0]
    untimed = catalog.tv.calls(spark, small).filter("called_at IS NULL").count()
    assert timed == untimed


def test_posture_sums_to_the_totals(spark, small):
    projects = catalog.QUERIES["severity_posture"](spark, small)
    sums = projects.groupBy().sum("info", "low", "medium", "high").first()
    total = catalog.QUERIES["severity_totals"](spark, small).first()
    assert tuple(sums) == (total["info"], total["low"], total["medium"], total["high"])
