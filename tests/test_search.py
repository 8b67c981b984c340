"""Searches that go on after a stop, and errors merged from stored sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.operators import forecast, scores
from pixelseries.operators.sampling import validation_split
from pixelseries.plans import forecasting
from pixelseries.sources import store

PARAMS = {"reg_param": [0.01, 0.1, 1.0], "elastic_net": [0.0, 0.5]}


def samples(spark, n=120):
    """Two context frames, two target frames, the target a noisy sum of the context."""
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        x = rng.normal(size=2)
        y = [float(x.sum() + 0.1 * rng.normal()), float(x[0] - x[1])]
        rows.append((f"s{i}", [(float(v),) for v in x], [(v,) for v in y]))
    return spark.createDataFrame(rows, "sample_id string, context array<struct<v: double>>, target array<struct<v: double>>")


def as_dict(found):
    return {r.trial: round(r.rmse, 12) for r in found.collect()}


def searched(spark, root, **more):
    return as_dict(forecasting.search(samples(spark), ["v"], "v", 2, PARAMS, str(root), val_fraction=0.25, seed=1, **more))


def test_a_search_in_pieces_gives_the_same_table(spark, tmp_path):
    whole = searched(spark, tmp_path / "a", batch=100)
    assert len(whole) == 6
    first = searched(spark, tmp_path / "b", batch=2, max_batches=1)
    assert len(first) == 2 and first.items() <= whole.items()
    assert searched(spark, tmp_path / "b", batch=3) == whole
    plain = {r.trial: r.rmse for r in forecasting.tune(samples(spark), ["v"], "v", 2, {"elastic_net": [0.0, 0.5], "reg_param": [0.01, 0.1, 1.0]}, 0.25, 1).collect()}
    assert sorted(round(v, 10) for v in plain.values()) == sorted(round(v, 10) for v in whole.values())


def test_a_killed_round_is_done_again_and_others_are_not(spark, tmp_path, monkeypatch):
    solved, solve = [], forecasting.solve_all
    monkeypatch.setattr(forecasting, "solve_all", lambda s, m, settings: solved.append(len(settings)) or solve(s, m, settings))
    write, calls = store.add_score_lists, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        write(*args)

    monkeypatch.setattr(store, "add_score_lists", dies)
    with pytest.raises(RuntimeError, match="killed"):
        searched(spark, tmp_path, batch=2)
    assert solved == [2, 2] and len(searched(spark, tmp_path, batch=2)) == 6 and solved == [2, 2, 2, 2]
    assert searched(spark, tmp_path, batch=2) and len(solved) == 4  # nothing is open any more


def test_a_search_without_gain_stops(spark, tmp_path):
    found = searched(spark, tmp_path, batch=1, patience=1)
    assert 1 < len(found) < 6


def test_settings_solved_in_tasks_equal_those_solved_here(spark):
    rows = forecast.training_rows(samples(spark), ["v"], "v")
    known = forecast.moments(rows, 2)
    settings = [{"reg_param": 0.1}, {"reg_param": 0.5, "elastic_net": 1.0}, {}]
    for (b, a), s in zip(forecast.solve_all(spark, known, settings), settings):
        want_b, want_a = known.solve(**s)
        assert np.array_equal(b, want_b) and np.array_equal(a, want_a)
    flagged = validation_split(rows, 0.25, 1)
    assert forecast.score_all(flagged.filter("is_val"), [known.solve()], 2).count() == 1


def test_merged_states_equal_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"r{i % 3}", f"t{i % 2}", float(rng.normal()), None if i % 11 == 0 else float(rng.normal())) for i in range(200)] + [("r9", "t9", 1.0, None)]
    pairs = spark.createDataFrame(rows, "run string, track string, pred double, truth double")
    states = scores.metric_states(pairs)
    store.write_states(states.withColumn("n", F.col("n") + 5), str(tmp_path / "s"))  # replaced below
    for run in ("r0", "r1", "r2", "r9"):
        store.write_states(states.filter(F.col("run") == run), str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == states.count() == 7
    got = {r.track: (r.n, r.rmse) for r in scores.merged_rmse(stored, ["track"]).collect()}
    for track in ("t0", "t1"):
        errors = [(p - t) ** 2 for _, k, p, t in rows if k == track and t is not None]
        assert got[track][0] == len(errors) and got[track][1] == pytest.approx(math.sqrt(sum(errors) / len(errors)))
    assert got["t9"] == (0, None)
    assert scores.merged_rmse(stored).first().rmse == pytest.approx(scores.rmse(pairs).first().rmse)
    assert scores.metric_states(pairs.limit(0)).count() == 0
