"""The training queries take all horizons and carry the walk-forward means."""

import datetime as dt
import random

import numpy as np

from tapeworks import registry
from tapeworks.plans import training as T

BARS = "ticker string, trade_date date, open int, high int, low int, close int, volume long"


def walks(spark, tickers, days):
    rng, rows = random.Random(4), []
    for t in range(tickers):
        p = 10000
        for i in range(days):
            p = max(1000, p + rng.randint(-200, 205))
            rows.append((f"T{t}", dt.date(2023, 1, 1) + dt.timedelta(i), p, p + 50, p - 50, p, rng.randint(50000, 150000)))
    return spark.createDataFrame(rows, BARS).coalesce(2).cache()


def test_sweep_has_every_horizon(spark, monkeypatch):
    bars = walks(spark, 6, 320)
    monkeypatch.setattr(registry.A, "bars", lambda *_: bars)
    rows = registry.queries()["sweep_horizons"](spark, "").collect()
    assert sorted(r.horizon for r in rows) == T.HORIZONS


def test_model_carries_walk_forward_means(spark, monkeypatch):
    bars = walks(spark, 6, 320)
    monkeypatch.setattr(registry.A, "bars", lambda *_: bars)
    model = registry.queries()["save_and_load_model"](spark, "").first()
    means = registry.queries()["walk_forward_summary"](spark, "").first()
    assert model.walkForwardFolds == means.n_folds > 0
    assert (model.holdoutAccuracy, model.holdoutAuc, model.baselineAccuracy) == (means.full_accuracy_mean, means.full_auc_mean, means.baseline_accuracy_mean)
    wide = registry._wide(walks(spark, 12, 165), [50])
    assert wide.where("label_rel_50 is not null").count() >= T.MIN_SAMPLES and T.train_final_model(wide).first() is None


def newton(x, y):
    mean, std = x.mean(axis=0), x.std(axis=0)
    z, beta, penal = np.column_stack(((x - mean) / std, np.ones(len(x)))), np.zeros(x.shape[1] + 1), np.append(np.ones(x.shape[1]), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penal), z.T @ (p - y) + penal * beta)
    return lambda t: 1 / (1 + np.exp(-(np.column_stack(((t - mean) / std, np.ones(len(t)))) @ beta)))


def brute_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return float(np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])))


def test_walk_forward_against_brute_force(spark):
    """Folds, purge, models, accuracy and AUC of two horizons, computed anew from the rows."""
    wide = registry._wide(walks(spark, 5, 200), [5, 20])
    rows, got = wide.toPandas(), {(r.horizon, r.fold): r for r in T.walk_forward(wide, [5, 20]).collect()}
    seen = 0
    for h in (5, 20):
        own = rows[rows[f"label_rel_{h}"].notna()]
        days = sorted(own["trade_date"].unique())
        for k in range(1, 6):
            start = days[min(len(days) * k // 6, len(days) - 1)]
            end = days[len(days) * (k + 1) // 6] if k < 5 else dt.date(9999, 1, 1)
            train = own[own[f"target_date_{h}"] < start]
            test = own[(own["trade_date"] >= start) & (own["trade_date"] < end)]
            if len(train) < T.MIN_TRAIN or len(test) < T.MIN_TEST:
                assert (h, k) not in got
                continue
            r, y = got[h, k], test[f"label_rel_{h}"].to_numpy()
            assert (r.before_purge, r.train_size, r.test_size) == (int((own["trade_date"] < start).sum()), len(train), len(test))
            most = float(train[f"label_rel_{h}"].mean() > 0.5)
            assert r.baseline_accuracy == round(float((y == most).mean()), 8)
            for names, a, b in ((T.FEATURES, r.full_accuracy, r.full_auc), (T.FEATURES[:-1], r.no_volume_accuracy, r.no_volume_auc)):
                p = newton(train[names].to_numpy(), train[f"label_rel_{h}"].to_numpy())(test[names].to_numpy())
                assert abs(b - brute_auc(p, y)) < 1e-9 and abs(a - float(((p > 0.5) == y).mean())) < 1e-9
            seen += 1
    assert seen == len(got) >= 6


def test_best_horizon_and_summary_on_fixed_rows(spark):
    sweep = spark.createDataFrame([(5, 900, 0.5, 0.5, None), (10, 900, 0.5, 0.5, 0.53), (20, 900, 0.5, 0.5, 0.53)], "horizon int, samples long, baseline_acc double, no_volume_auc double, full_auc double")
    assert tuple(T.best_horizon(sweep).first()) == (10, 0.53, False)
    assert tuple(T.best_horizon(sweep.where("horizon = 5")).first()) == (5, None, True)
    folds = spark.createDataFrame([(5, 0.4, 0.5, 0.5, 0.5, 0.6), (5, 0.6, 0.5, 0.5, None, None)], "horizon int, " + ", ".join(f"{m} double" for m in T.METRICS))
    r = T.walk_forward_summary(folds).first()
    assert (r.n_folds, round(r.baseline_accuracy_mean, 9), round(r.baseline_accuracy_std, 9), r.full_auc_mean, r.full_auc_std) == (2, 0.5, 0.1, 0.6, 0.0)
