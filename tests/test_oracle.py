"""Every registered query with check SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from cohortlens.operators.model import Boosting
from cohortlens.plans import catalog
from conftest import SMALL
from oracle_check import differences, duck

SQL = contract.oracle_sql()
SHORT = Boosting(trees=3, depth=3)
MAY_BE_EMPTY = {"search_trials", "alarm_periods", "stream_alarms", "over_limit", "stream_over_limit", "source_filter_cap"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(contract.queries())


def test_models_train_with_the_published_settings():
    assert (catalog.BOOSTING.trees, catalog.BOOSTING.depth, catalog.BOOSTING.step) == (300, 6, 0.05)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name, monkeypatch):
    monkeypatch.setattr(catalog, "BOOSTING", SHORT)
    problems = differences(contract.queries()[name](spark, SMALL), con, SQL[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


def test_entry(spark):
    assert contract.entry(spark).count() == 5
