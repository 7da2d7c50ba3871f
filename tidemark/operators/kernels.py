"""Sequential kernels that windows can't express: seasonal decomposition and
ARIMA, numpy behind ``applyInPandas``; a task holds one series at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import series as S

MIN_CYCLES = 5


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Local linear fits with tricube weights over the ``span`` nearest points."""
    out = np.empty(len(at))
    q = min(span, len(x))
    for i, t in enumerate(at):
        far = np.abs(x - t)
        near = np.argsort(far, kind="stable")[:q]
        h = max(far[near].max(), 1e-9) * max(1.0, span / len(x))
        w = np.maximum(1 - np.minimum(far[near] / (h * 1.000001), 1) ** 3, 0) ** 3 * weights[near]
        if w.sum() <= 0:
            w = np.ones(q)
        m = np.average(x[near], weights=w)
        b = np.average(y[near], weights=w)
        d = x[near] - m
        s = (w * d * d).sum()
        out[i] = b + (0 if s < 1e-12 else (w * d * (y[near] - b)).sum() / s * (t - m))
    return out


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.ones(n) / n, "valid")


def stl(values: np.ndarray, period: int = 12, inner: int = 2, outer: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """[W-13] Robust seasonal-trend decomposition by LOESS; None below five full
    cycles or on a flat series. Season by each month's own smooth, its low
    frequencies taken out, then the trend of what is left; points of large
    residual lose weight."""
    y = np.asarray(values, float)
    n = len(y)
    if n < MIN_CYCLES * period or np.allclose(y, y[0]):
        return None
    seasonal_span, low = 7, period + 1 - period % 2
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal_span)))
    trend_span += 1 - trend_span % 2
    trend, season, rho, at = np.zeros(n), np.zeros(n), np.ones(n), np.arange(n, dtype=float)
    for k in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for m in range(period):
                rows = np.arange(m, n, period)
                x = np.arange(len(rows), dtype=float)
                cycle[m::period] = loess(x, (y - trend)[rows], np.arange(-1, len(rows) + 1, dtype=float), seasonal_span, rho[rows])
            smooth = _moving(_moving(_moving(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(at, smooth, at, low, np.ones(n))
            trend = loess(at, y - season, at, trend_span, rho)
        rest = y - season - trend
        if k < outer:
            h = 6 * np.median(np.abs(rest))
            rho = np.maximum(1 - np.minimum(np.abs(rest) / h, 1) ** 2, 0) ** 2 if h > 0 else np.ones(n)
    return trend, season, y - season - trend


def _residuals(p: np.ndarray, d: np.ndarray, season: int) -> np.ndarray:
    """One-step errors of (1 - a B)(1 - b B^season) d = (1 + c B) e."""
    a, b, c = p
    e = np.zeros(len(d))
    for t in range(len(d)):
        ar = a * d[t - 1] if t else 0.0
        if season > 1:
            ar += (b * d[t - season] if t >= season else 0.0) - (a * b * d[t - season - 1] if t > season else 0.0)
        e[t] = d[t] - ar - (c * e[t - 1] if t else 0.0)
    return e


def arima(values: np.ndarray, season: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """[W-19] ARIMA(1,1,1)(1,0,0) by conditional sum of squares (no seasonal term
    below two cycles), with an 80 % interval; None where it can't be fitted."""
    y = np.asarray(values, float)
    if len(y) < 6:
        return None
    if season <= 1 or len(y) < 2 * season:
        season = 1
    d, free = np.diff(y), [0, 2] if season == 1 else [0, 1, 2]
    if np.allclose(d, 0):
        return None
    p = np.zeros(3)
    best = float((_residuals(p, d, season) ** 2).sum())
    step = 0.4
    while step > 0.004:  # pattern search within the stationary box
        moved = False
        for i in free:
            for sign in (1, -1):
                q = p.copy()
                q[i] = np.clip(q[i] + sign * step, -0.98, 0.98)
                cost = float((_residuals(q, d, season) ** 2).sum())
                if cost < best - 1e-12 * abs(best):
                    p, best, moved = q, cost, True
        step = step if moved else step / 2
    a, b, c = p
    e = list(_residuals(p, d, season))
    path, mean = list(d), []
    for _ in range(horizon):
        t = len(path)
        v = a * path[t - 1] + c * e[-1]
        if season > 1:
            v += b * path[t - season] - a * b * path[t - season - 1]
        path.append(v)
        e.append(0.0)
        mean.append((mean[-1] if mean else y[-1]) + v)
    psi, cum = [1.0, a + c], [1.0]
    while len(psi) < horizon:
        psi.append(a * psi[-1])
    for k in range(1, horizon):
        cum.append(cum[-1] + psi[k])
    sigma = np.sqrt(best / max(1, len(d) - len(free)))
    half = 1.2816 * sigma * np.sqrt(np.cumsum(np.square(cum)))
    m = np.asarray(mean)
    return m, m - half, m + half


_STL = "grain string, entity_key string, direction string, measure string, period string, sort_key int, tonnage_kg double, trend_kg double, seasonal_kg double, residual_kg double"


def decomposed(series: DataFrame) -> DataFrame:
    """[W-13] Long enough series with their components."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sort_key")
        found = stl(pdf["tonnage_kg"].to_numpy())
        if found is None:
            return pdf.iloc[:0].assign(trend_kg=0.0, seasonal_kg=0.0, residual_kg=0.0)
        return pdf.assign(**dict(zip(("trend_kg", "seasonal_kg", "residual_kg"), found, strict=True)))

    rows = S.trimmed(series).select(*S.KEYS, "period", F.col("sort_key").cast("int"), "tonnage_kg")
    return rows.groupBy(*S.KEYS).applyInPandas(run, _STL)


def seasonal(series: DataFrame) -> DataFrame:
    """[W-14] Points whose residual is far from the series' residuals."""
    z = S.global_robust_z(decomposed(series), "residual_kg")
    v, due = F.col("tonnage_kg"), F.col("trend_kg") + F.col("seasonal_kg")
    off = S.pct(v, due)
    hit = z.where((F.abs("global_z") >= 4.5) & (v >= 100_000) & (due > 0) & (F.abs(off) >= 25))
    return hit.select(*S.KEYS, "period", "sort_key", v.alias("observed_kg"), due.alias("expected_kg"), off.alias("deviation_pct"), F.round("global_z", 3).alias("z_score"), F.lit("stl_residual").alias("method"), S.severity(F.col("global_z")).alias("severity"))


def detect(series: DataFrame) -> DataFrame:
    """[W-16] All three detectors merged."""
    return S.merged(S.structural(series), S.statistical(series), seasonal(series))


def arima_forecasts(series: DataFrame, horizon: int = 3) -> DataFrame:
    """[W-19, W-20] ARIMA forecasts of series where its backtest error beats all
    simple candidates' and is at most 35 %."""
    out = "grain string, entity_key string, direction string, measure string, horizon int, predicted_kg double, lower_kg double, upper_kg double, mape double, interval_hits int, interval_folds int"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sort_key")
        y, yearly = pdf["tonnage_kg"].to_numpy(), str(pdf["period"].iloc[0])[-1] in "YA"
        season = 1 if yearly else 12
        none = pd.DataFrame(columns=["grain", "entity_key", "direction", "measure", "horizon", "predicted_kg", "lower_kg", "upper_kg", "mape", "interval_hits", "interval_folds"])
        if len(y) < max(season + 2, 6) + S.FOLDS:
            return none
        errors, hits = [], 0
        for k in range(S.FOLDS, 0, -1):
            fit = arima(y[:-k], season, 1)
            if fit is None:
                return none
            hits += int(max(0.0, fit[1][0]) <= y[-k] <= fit[2][0])
            if y[-k] != 0:
                errors.append(abs((y[-k] - fit[0][0]) / y[-k]))
        mape = round(float(np.mean(errors)) * 100, 2) if errors else np.inf
        fit = arima(y, season, horizon) if mape <= S.MAX_MAPE else None
        if fit is None:
            return none
        m, lo, hi = (np.maximum(x, 0).round(3) for x in fit)
        return pd.DataFrame({**dict(zip(S.KEYS, key, strict=True)), "horizon": range(1, horizon + 1), "predicted_kg": m, "lower_kg": lo, "upper_kg": hi, "mape": mape, "interval_hits": hits, "interval_folds": S.FOLDS})

    fitted = series.select(*S.KEYS, "period", "sort_key", "tonnage_kg").groupBy(*S.KEYS).applyInPandas(run, out)
    simple = S.winners(series).select(*S.KEYS, F.col("mape").alias("_simple"))
    return fitted.join(simple, S.KEYS, "left").where("_simple is null or mape < _simple").drop("_simple")


def published(series: DataFrame, horizon: int = 3) -> DataFrame:
    """[W-21] Forecasts by the best of five candidates: ARIMA where its error is
    the least, else the best simple one."""
    best = arima_forecasts(series, horizon)
    last = series.groupBy(*S.KEYS).agg(F.max_by("period", "sort_key").alias("_last"))
    own = best.join(last, S.KEYS).select(*S.KEYS, periods.next_label(F.col("_last"), F.col("horizon")).alias("period"), "horizon", "predicted_kg", "lower_kg", "upper_kg", F.lit("sarima").alias("model"), F.col("mape").alias("backtest_mape"), F.col("interval_hits").cast("int"), F.col("interval_folds").cast("int"))
    simple = S.forecasts(series, horizon).join(best.select(*S.KEYS).distinct(), S.KEYS, "left_anti")
    return simple.unionByName(own)
