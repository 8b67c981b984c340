"""Every registered query against its SQL, on the smallest tables."""

import pytest

from checks.compare import compare, duck
from checks.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_oracle_covers_all_but_the_fitted_models():
    assert set(QUERIES) - set(ORACLE) == {"q_forecast", "q_grid_search"}


def test_ridge_scores_cover_every_window(spark):
    found = {r.step: r.n for r in QUERIES["q_ridge_forecast"](spark, SF).collect()}
    assert found == dict.fromkeys(range(3), 20 * (477 - 362))  # all starts but those that end before 2000


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row.n_samples == 20 * 410
    assert row.rmse_mean == pytest.approx(row.mse_mean**0.5, abs=1e-3)
