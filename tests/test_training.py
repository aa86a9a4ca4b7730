"""Rank-loss training: gradients against finite differences, equal runs, early stopping."""

import dataclasses
import datetime as dt

import numpy as np
import pytest

from larkspur.operators import models as L
from larkspur.operators import training as G

SMALL = G.Config(hidden=5, batch_dates=4, epochs=6, patience=2, rate=0.02, dropout=0.0)


def dates(rng, n_dates, n=12, inputs=3):
    out = []
    for d in range(n_dates):
        x = rng.normal(size=(n, inputs))
        rank, z = rng.permutation(n) / n + 1.0 / n, rng.normal(size=n)
        if d == 1:
            rank[:4], z[2:5] = np.nan, np.nan
        out.append((x, rank, z, d))
    return out


def total(params, days, config, step):
    sums = sum(G.date_sums(params, x, r, z, config, step, d) for x, r, z, d in days)
    return G.combined(sums, config)


@pytest.mark.parametrize("least_spread", [0.0, 0.05, 5.0])
@pytest.mark.parametrize("step", [None, 3])
def test_gradient_equals_finite_differences(least_spread, step):
    config = dataclasses.replace(SMALL, least_spread=least_spread, dropout=0.3)
    rng = np.random.default_rng(1)
    days, params = dates(rng, 3), G.initial(3, config)
    grad, loss = total(params, days, config, step)
    assert set(loss) == {"total_loss", "ic_loss", "huber_loss", "variance_penalty"} and (loss["variance_penalty"] > 0) >= (least_spread > 1)
    flat = np.concatenate([p.ravel() for p in params])
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (total(G.unpacked(up, params), days, config, step)[1]["total_loss"] - total(G.unpacked(down, params), days, config, step)[1]["total_loss"]) / 2e-4
        assert abs(slope - grad[i]) < 2e-4 * max(1.0, abs(grad[i]))


def test_degenerate_dates_add_nothing():
    params = G.initial(2, SMALL)
    one = G.date_sums(params, np.zeros((1, 2)), np.array([1.0]), np.array([np.nan]), SMALL)
    same = G.date_sums(params, np.ones((5, 2)), np.ones(5), np.zeros(5), SMALL)
    assert not one[6:].any() and one[3:6].tolist() == [0, 0, 0]
    assert not same[6:].any() and same[3:6].tolist() == [0, 5, 1] and np.isfinite(same).all()


def panel(spark, noise=0.2):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(24):
        for t in range(15):
            a, b = rng.normal(size=2)
            split = "train" if i < 16 else "valid" if i < 20 else "test"
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), f"t{t}", split, float(a), float(b) if t else None, float(np.tanh(a) - 0.5 * b + noise * rng.normal()) if t != 3 else None))
    return spark.createDataFrame(rows, "date date, ticker string, split string, a double, b double, y double")


def test_two_runs_give_equal_weights_and_order_returns(spark, tmp_path):
    df = panel(spark)
    one = G.train(df.repartition(3), str(tmp_path / "one"), "y", ["a", "b"], dataclasses.replace(SMALL, dropout=0.1))
    two = G.train(df.repartition(7), str(tmp_path / "two"), "y", ["a", "b"], dataclasses.replace(SMALL, dropout=0.1))
    assert one.history == two.history and all(np.array_equal(a, b) for a, b in zip(one.params, two.params, strict=True))
    assert len(one.history) <= 6 and one.history[-1]["total_loss"] < one.history[0]["total_loss"]
    best = max(one.history, key=lambda h: h["valid_RankIC"])
    assert one.best_epoch == best["epoch"] and best["valid_RankIC"] > 0.5
    out = G.evaluated(df, "y", one)
    assert out["predictions"].count() == 360
    assert {r["split"]: r["RankIC"] > 0.5 for r in out["metrics"].collect()} == {"train": True, "valid": True, "test": True}


def test_training_stops_without_a_better_epoch(spark, tmp_path, monkeypatch):
    found = iter([0.1, 0.3, 0.2, None, 0.9])
    monkeypatch.setattr(G, "valid_rank_ic", lambda *a: (next(found), None))
    done = G.train(panel(spark), str(tmp_path / "run"), "y", ["a"], SMALL)
    assert [h["improved"] for h in done.history] == [True, True, False, False] and done.best_epoch == 2


def test_summed_gradient_of_tasks_is_that_of_the_days(spark, tmp_path):
    df = G.batches_by_date(G.rank_loss_panel(panel(spark), "y", ["a", "b"]).where("y_rank IS NOT NULL"), 100)
    days = G.packed_days(df, ["a", "b"])
    params = G.initial(2, SMALL)
    got = G.batch_sums(days.repartition(5), params, SMALL, 1)
    want = np.zeros_like(got)
    for r in days.collect():
        m = np.frombuffer(r["body"]).reshape(r["rows"], -1)
        want += G.date_sums(params, m[:, :-2], m[:, -2], m[:, -1], SMALL, 1, r["day"])
    assert np.allclose(got, want)
    # The metric form of the loss is that of the gradient.
    scored = G.predict(df, ["a", "b"], params)
    row, loss = L.rank_loss(scored, "pred", "y_rank", "y_z", least_spread=0.05).first(), G.combined(got, SMALL)[1]
    assert abs(row["ic_loss"] - loss["ic_loss"]) < 1e-6 and abs(row["huber_loss"] - loss["huber_loss"]) < 1e-6 and abs(row["variance_penalty"] - loss["variance_penalty"]) < 1e-9 and abs(row["loss"] - loss["total_loss"]) < 1e-6
