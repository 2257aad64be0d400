"""Registered queries against their SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import difference, duck
from rankloom.catalog.queries import QUERIES

# Long ones, and those that share all their steps with another, are covered by
# ``python check.py``.
SWEEPS = {"experiment_sweep", "all_methods_run", "ivf_trials", "trial_summary", "results_csv", "results_json", "summary_table", "method_pivot"}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SWEEPS))
def test_agrees_with_sql(spark, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert difference(got, duck(folder).execute(oracle_sql()[name]).df()) is None
