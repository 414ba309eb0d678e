"""Every query with an SQL oracle equals it (sf0.001; the driver uses sf0.01)."""

import pytest

from glossa.catalog import oracle_sql, queries

from paths import SF001

import tools.oracle_check as oc

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def results(spark):
    return oc.check(spark, SF001, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(results, name):
    status, detail = results[name]
    assert status == "match", f"{name}: {status} {detail}"


def test_every_query_runs_rows_only(spark):
    rows_only = sorted(set(queries()) - set(oracle_sql()))
    res = oc.check(spark, SF001, rows_only, verbose=False)
    for name in rows_only:
        assert res[name][0] == "rows-only", (name, res[name])
