"""Kernels against literal series and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels, series

SCHEMA = "grain string, entity_key string, direction string, measure string, period string, sort_key int, tonnage_kg double, prior_kg double"


def frame(spark, name, values, kind="M", prior=None):
    label = (lambda i: f"{2015 + i // 12}-{i % 12 + 1:02d}") if kind == "M" else (lambda i: f"{2000 + i}-FY")
    rows = [("AIRPORT", name, "TOTAL", "freight", label(i), i, float(v), None if prior is None else prior[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def totals(spark, df):
    return df.groupBy("period", "direction").agg((F.sum("tonnage_kg") * 2).alias("total_kg"))


def test_trend(spark):
    df = frame(spark, "A", [100.0] * 12 + [150.0])
    got = series.trend(df, totals(spark, df)).orderBy("sort_key").collect()
    assert [r["yoy_pct"] for r in got] == [None] * 12 + [50.0]
    assert got[0]["mom_pct"] is None and got[12]["mom_pct"] == 50.0 and got[12]["share_of_total"] == 50.0
    fy = frame(spark, "B", [100, 110, 0, 5], "F", [None, 0.0, 100.0, None])
    got = series.trend(fy, totals(spark, fy)).orderBy("sort_key").collect()
    assert [r["yoy_pct"] for r in got] == [None, 10.0, -100.0, None]


def test_spike_and_guards(spark):
    steady = [20_000 + 500 * (i % 3) for i in range(12)]
    spike = frame(spark, "A", [*steady, 90_000, *steady[:3]])
    got = series.statistical(spike).collect()
    assert [(r["sort_key"], r["severity"]) for r in got] == [(12, "HIGH")]
    for values in ([0] * 20 + [50_000] * 3, [100, 120, 90, 100, 5_000, 110, 100, 100], [0, 0, 0, 100, 900, 5000, 20_000, 60_000]):
        assert series.statistical(frame(spark, "B", values)).count() == 0


def test_zero_mad_falls_back(spark):
    flat = frame(spark, "A", [10.0] * 8 + [40.0])
    z = [r["z"] for r in series.local_robust_z(flat).orderBy("sort_key").collect()]
    assert abs(z[8] - (40 - np.mean([10] * 8 + [40])) / np.std([10] * 8 + [40])) < 1e-9
    near = [10.0] * 7 + [12.0]  # the past varies, its MAD is 0
    z = series.local_robust_z(frame(spark, "B", [*near, 20.0])).orderBy("sort_key").collect()[8]
    assert abs(z["z"] - (20 - np.mean(near)) / np.std(near)) < 1e-9 and z["baseline_kg"] == 10.0


def test_structural(spark):
    up, down = [0, 0, 0, 5e6, 5e6, 6e6, 5e6], [9e4, 9e4, 9e4, 8e4, 0, 0, 0, 0]
    got = series.structural(frame(spark, "A", up)).unionByName(series.structural(frame(spark, "B", down))).collect()
    assert {(r["entity_key"], r["method"], r["sort_key"], r["severity"]) for r in got} == {("A", "service_started", 3, "HIGH"), ("B", "service_stopped", 3, "MEDIUM")}
    assert series.structural(frame(spark, "C", [5, 5, 5, 0, 5, 5, 5])).count() == 0


def test_merge_and_one_alert(spark):
    def alert(method, dev, sev, direction="TOTAL"):
        return spark.createDataFrame([("AIRPORT", "A", direction, "f", "2020-01", 1, 1e6, 5e5, dev, 5.0, method, sev)], "grain string, entity_key string, direction string, measure string, period string, sort_key int, observed_kg double, expected_kg double, deviation_pct double, z_score double, method string, severity string")

    none = alert("x", 0.0, "LOW").limit(0)
    both = series.merged(none, alert("robust_z", 100.0, "HIGH"), alert("stl_residual", 90.0, "LOW")).collect()
    assert [(r["method"], r["severity"], r["deviation_pct"]) for r in both] == [("consensus", "MEDIUM", 90.0)]
    one = series.one_alert(alert("robust_z", 100.0, "HIGH").unionByName(alert("robust_z", -200.0, "HIGH", "DOMESTIC"))).collect()
    assert [r["direction"] for r in one] == ["DOMESTIC"]


def test_forecasts(spark):
    flat = series.forecasts(frame(spark, "A", [100.0] * 14)).orderBy("horizon").collect()
    assert [(r["period"], r["predicted_kg"], r["model"], r["backtest_mape"]) for r in flat] == [(f"2016-{m:02d}", 100.0, "naive", 0.0) for m in (3, 4, 5)]
    assert all(r["lower_kg"] <= r["predicted_kg"] <= r["upper_kg"] for r in flat) and flat[0]["interval_hits"] == 3
    fy = series.forecasts(frame(spark, "B", [100 + 10 * i for i in range(10)], "F")).orderBy("horizon").collect()
    assert fy[0]["period"] == "2010-FY" and fy[0]["model"] == "drift" and fy[0]["predicted_kg"] == pytest.approx(200.0)
    assert series.forecasts(frame(spark, "C", [1, 100, 2, 300, 5, 900, 1, 700, 2])).count() == 0
    assert series.forecasts(frame(spark, "D", [5.0] * 7)).count() == 0


def test_seasonal_naive(spark):
    c = series.candidates(frame(spark, "A", list(range(24)))).orderBy("sort_key").collect()
    assert c[23]["seasonal_naive"] == 12.0 and c[5]["seasonal_naive"] == 5.0


def test_stl_and_arima():
    rng = np.random.default_rng(0)
    t = np.arange(79)
    y = 1000 + 10 * t + 200 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 20, 79)
    y[40] += 900
    trend, season, rest = kernels.stl(y)
    assert np.allclose(trend + season + rest, y) and np.argmax(np.abs(rest)) == 40 and np.std(np.delete(rest, 40)) < 40
    assert kernels.stl(y[:36]) is None and kernels.stl(np.ones(72)) is None
    mean, low, high = kernels.arima(y, 12, 3)
    assert (low <= mean).all() and (mean <= high).all() and (np.diff(high - low) >= 0).all()
    assert kernels.arima(np.ones(20), 12, 3) is None and kernels.arima(y[:5], 12, 3) is None


def test_kernels_run_distributed(spark):
    t = np.arange(72)
    df = frame(spark, "A", 500_000 + 1000 * t + 90_000 * np.sin(2 * np.pi * t / 12) + np.where(t == 30, 900_000, 0))
    assert kernels.decomposed(df).count() == 72
    assert [(r["sort_key"], r["method"]) for r in kernels.seasonal(df).collect()] == [(30, "stl_residual")]
    assert 30 in [r["sort_key"] for r in kernels.detect(df).collect()]
