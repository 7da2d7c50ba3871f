"""Series of a measure by period, and what is computed along them.

A series is (grain, entity_key, direction, measure), ordered by ``sort_key``. All
kernels share one partitioning, so Spark shuffles once for any chain of them.
Lags are positional: a missing period shifts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import periods

KEYS = ["grain", "entity_key", "direction", "measure"]


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("sort_key")


def whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def build(facts: DataFrame, min_points: int = 1) -> DataFrame:
    """[A-2] Facts summed to series of at least ``min_points`` periods; industry
    totals are left out."""
    kept = facts.where(F.coalesce(~F.col("is_aggregate"), F.lit(True)))
    entity = F.coalesce("airport_iata", "airport_name", "airline_name").alias("entity_key")
    summed = kept.groupBy("grain", entity, "direction", "measure", "period", "sort_key").agg(F.sum("tonnage_kg").alias("tonnage_kg"), F.sum("prior_year_tonnage_kg").alias("prior_kg"))
    return summed.withColumn("n_points", F.count("*").over(whole())).where(F.col("n_points") >= min_points)


def national_totals(facts: DataFrame) -> DataFrame:
    """[A-3] Totals of all airports by period and direction."""
    return facts.where("grain = 'AIRPORT'").groupBy("period", "direction").agg(F.sum("tonnage_kg").alias("total_kg"))


def pct(now: Column, then: Column) -> Column:
    """[W-2] Change in per cent; null on a null or zero base."""
    return F.round(F.try_divide(now - then, then) * 100, 2)


def trend(series: DataFrame, totals: DataFrame) -> DataFrame:
    """[W-3 to W-7] Month on month, year on year, compound growth and share."""
    joined = series.join(totals, ["period", "direction"], "left")
    v, total = F.col("tonnage_kg"), F.nullif(F.col("total_kg"), F.lit(0.0))
    yearly = F.first("period").over(ordered()).rlike("-(FY|A)$")

    def back(c: Column) -> Column:
        return F.when(yearly, F.lag(c, 1).over(ordered())).otherwise(F.lag(c, 12).over(ordered()))

    i, first = F.row_number().over(ordered()) - 1, F.first("tonnage_kg").over(ordered())
    growth = F.round((F.pow(v / first, F.lit(1.0) / i) - 1) * 100, 2)
    share = v / total * 100
    return joined.select(
        *KEYS, "period", "sort_key", "tonnage_kg",
        F.coalesce(pct(v, F.nullif(F.col("prior_kg"), F.lit(0.0))), pct(v, back(v))).alias("yoy_pct"),
        pct(v, F.lag("tonnage_kg", 1).over(ordered())).alias("mom_pct"),
        F.when((i >= 1) & (first > 0) & (v >= 0), growth).alias("cagr_pct"),
        F.round(share, 3).alias("share_of_total"),
        (F.round(F.round(share, 3) - back(share), 3) + 0.0).alias("share_shift_pp"),  # no negative zero
    )


# ---- anomalies


def median(values: Column) -> Column:
    """The median of an array."""
    s, n = F.sort_array(values), F.size(values)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def _deviation(values: Column, centre: Column) -> Column:
    return median(F.transform(values, lambda x: F.abs(x - centre)))


def global_robust_z(series: DataFrame, value: str = "tonnage_kg") -> DataFrame:
    """[W-8] 0.6745 (x - median) / MAD over the whole series; by mean and
    deviation where the MAD is 0, 0 where that is 0 too."""
    v, mid = F.col(value), F.expr(f"percentile({value}, 0.5)").over(whole())
    step = series.withColumn("global_median", mid).withColumn("_off", F.abs(v - F.col("global_median")))
    mad, sd, mean = F.expr("percentile(_off, 0.5)").over(whole()), F.stddev_pop(v).over(whole()), F.avg(v).over(whole())
    z = F.when(mad != 0, 0.6745 * (v - F.col("global_median")) / mad).when(sd != 0, (v - mean) / sd).otherwise(0.0)
    return step.withColumn("global_z", z).drop("_off")


def local_robust_z(series: DataFrame, window: int = 12) -> DataFrame:
    """[W-9] As the global z, against the ``window`` periods before; with fewer
    than half (6 at least) of them, or none that differ, the global z stands."""
    g = global_robust_z(series)
    past = F.collect_list("tonnage_kg").over(ordered().rowsBetween(-window, -1))
    g = g.withColumn("_past", past).withColumn("_med", median(F.col("_past"))).withColumn("_mad", _deviation(F.col("_past"), F.col("_med")))
    n = F.size("_past")
    mean = F.aggregate("_past", F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    g = g.withColumn("_mean", mean).withColumn("_sd", F.sqrt(F.aggregate(F.transform("_past", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))))
    local = (n >= max(6, window // 2)) & ((F.col("_mad") != 0) | (F.col("_sd") != 0))
    v = F.col("tonnage_kg")
    z = F.when(local & (F.col("_mad") != 0), 0.6745 * (v - F.col("_med")) / F.col("_mad")).when(local, (v - F.col("_mean")) / F.col("_sd")).otherwise(F.col("global_z"))
    base = F.when(local, F.col("_med")).otherwise(F.col("global_median"))
    return g.withColumns({"z": z, "baseline_kg": base}).drop("_past", "_med", "_mad", "_mean", "_sd")


def severity(z: Column) -> Column:
    """[W-12]"""
    return F.when(F.abs(z) >= 4, "HIGH").when(F.abs(z) >= 3, "MEDIUM").otherwise("LOW")


def trimmed(series: DataFrame) -> DataFrame:
    """[W-10] Without the zeros a series opens with."""
    seen = F.max("tonnage_kg").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("_seen", seen).where("_seen > 0").drop("_seen")


def statistical(series: DataFrame, threshold: float = 3.0) -> DataFrame:
    """[W-11] Points far from their recent past, in series that are long, dense
    and large enough to have one."""
    z = local_robust_z(trimmed(series))
    v = F.col("tonnage_kg")
    z = z.withColumns({"_n": F.count("*").over(whole()), "_some": F.avg((v > 0).cast("double")).over(whole()), "_peak": F.max(v).over(whole())})
    sound = (F.col("_n") >= 6) & (F.col("_some") >= 0.5) & (F.col("global_median") >= 10_000) & (F.try_divide(F.col("global_median"), F.col("_peak")) >= 0.15)
    hit = z.where(sound & (F.abs("z") >= threshold) & (v >= 1000))
    base = F.col("baseline_kg")
    return hit.select(*KEYS, "period", "sort_key", v.alias("observed_kg"), base.alias("expected_kg"), pct(v, base).alias("deviation_pct"), F.round("z", 3).alias("z_score"), F.lit("robust_z").alias("method"), severity(F.col("z")).alias("severity"))


def structural(series: DataFrame, window: int = 3) -> DataFrame:
    """[W-15] A service that starts or stops: ``window`` zeros on one side,
    ``window`` positive periods on the other."""
    past, ahead = ordered().rowsBetween(-window, -1), ordered().rowsBetween(1, window)
    v = F.col("tonnage_kg")
    s = series.select("*", *[f("tonnage_kg").over(w).alias(f"_{n}{k}") for k, w in (("b", past), ("a", ahead)) for n, f in (("min", F.min), ("max", F.max), ("n", F.count), ("all", F.collect_list))])
    full = (F.col("_nb") == window) & (F.col("_na") == window) & (v > 0)
    started = full & (F.col("_minb") == 0) & (F.col("_maxb") == 0) & (F.col("_mina") > 0)
    stopped = full & (F.col("_minb") > 0) & (F.col("_mina") == 0) & (F.col("_maxa") == 0)
    level = median(F.when(started, F.col("_alla")).otherwise(F.col("_allb")))
    return s.where(started | stopped).select(*KEYS, "period", "sort_key", v.alias("observed_kg"), F.when(started, 0.0).otherwise(level).alias("expected_kg"), F.lit(None).cast("double").alias("deviation_pct"), F.lit(None).cast("double").alias("z_score"), F.when(started, "service_started").otherwise("service_stopped").alias("method"), F.when(level >= 1_000_000, "HIGH").otherwise("MEDIUM").alias("severity"))


def is_material() -> Column:
    """[F-10] Large enough to act on."""
    size = F.greatest("observed_kg", "expected_kg") / 1000
    return F.when(F.col("method").isin("service_started", "service_stopped"), size >= 50).otherwise((size >= 500) & (F.abs(F.coalesce("deviation_pct", F.lit(0.0))) >= 25))


def merged(structural_: DataFrame, statistical_: DataFrame, seasonal: DataFrame) -> DataFrame:
    """[W-16] Structural points win; where both others fire, the seasonal values
    stand as ``consensus`` with a raised severity."""
    key = [*KEYS, "period", "sort_key"]
    names = ["observed_kg", "expected_kg", "deviation_pct", "z_score", "method", "severity"]
    a = statistical_.select(*key, F.struct(*names).alias("stat"))
    b = seasonal.select(*key, F.struct(*names).alias("seas"))
    both = a.join(b, key, "full_outer").join(structural_.select(*key), key, "left_anti")
    pick = F.coalesce("seas", "stat")
    agreed = F.col("stat").isNotNull() & F.col("seas").isNotNull()
    method = F.when(agreed, "consensus").otherwise(pick["method"])
    level = F.when(agreed, F.when(pick["severity"] != "LOW", "HIGH").otherwise("MEDIUM")).otherwise(pick["severity"])
    rest = both.select(*key, *[pick[n].alias(n) for n in names[:4]], method.alias("method"), level.alias("severity"))
    return structural_.select(*key, *names).unionByName(rest)


def one_alert(alerts: DataFrame) -> DataFrame:
    """[W-17] One alert for an entity and period: structural first, then the
    largest deviation, then series order."""
    rank = Window.partitionBy("grain", "entity_key", "period").orderBy(F.col("method").startswith("service_").desc(), F.abs("deviation_pct").desc_nulls_last(), "direction", "measure")
    return alerts.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


# ---- forecasts

FOLDS = 3
MAX_MAPE = 35.0
INTERVAL_K = 1.70
NAMES = ("naive", "drift", "recent_mean", "seasonal_naive")


def candidates(series: DataFrame) -> DataFrame:
    """[W-18] What each candidate predicts one step after every row; ``season``
    is 12, or 1 for yearly series."""
    v = F.col("tonnage_kg")
    yearly = F.first("period").over(ordered()).rlike("-(FY|A)$")
    n, first = F.row_number().over(ordered()), F.first("tonnage_kg").over(ordered())

    def recent(k: int) -> Column:
        return F.avg("tonnage_kg").over(ordered().rowsBetween(1 - k, 0))

    return series.withColumns({
        "i": n, "season": F.when(yearly, 1).otherwise(12),
        "naive": v,
        "slope": F.when(n >= 2, (v - first) / (n - 1)).otherwise(0.0),
        "recent_mean": F.when(yearly, recent(6)).otherwise(recent(12)),
        "seasonal_naive": F.when(~yearly & (n >= 12), F.lag("tonnage_kg", 11).over(ordered())).otherwise(v),
    }).withColumn("drift", v + F.col("slope"))


def backtest(series: DataFrame) -> DataFrame:
    """[W-20, A-25] Mean absolute percentage error of each candidate over the
    last three periods, each predicted from the row before; long form."""
    c = candidates(series).withColumn("n", F.count("*").over(whole()))
    c = c.withColumns({f"p_{k}": F.lag(k).over(ordered()) for k in NAMES})
    folds = c.where((F.col("n") >= 6) & (F.col("i") > F.col("n") - FOLDS))
    need = {"naive": F.lit(2), "drift": F.lit(3), "recent_mean": F.lit(3), "seasonal_naive": F.col("season")}
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(k).alias("model"), F.col(f"p_{k}").alias("predicted"), need[k].alias("need")) for o, k in enumerate(NAMES)])).alias("m")
    long = folds.select(*KEYS, "n", "season", F.col("tonnage_kg").alias("actual"), each).select(*KEYS, "n", "season", "actual", "m.*").where("n >= need + 3")
    error = F.avg(F.when(F.col("actual") != 0, F.abs((F.col("actual") - F.col("predicted")) / F.col("actual"))))
    return long.groupBy(*KEYS, "n", "season", "ord", "model").agg(F.round(error * 100, 2).alias("mape"), F.collect_list(F.struct("actual", "predicted")).alias("folds")).where("mape is not null")


def interval(point: Column, mape: Column) -> tuple[Column, Column]:
    """[W-22] The 80 % band of a simple model."""
    spread = F.greatest(F.abs(point) * mape / 100, F.abs(point) * 0.02)
    return F.greatest(F.lit(0.0), point - INTERVAL_K * spread), point + INTERVAL_K * spread


def winners(series: DataFrame) -> DataFrame:
    """[W-21, W-23] The candidate of least error (ties: in order), with how many
    folds its band holds; those beyond 35 % are refused."""
    key = F.struct("mape", "ord", "model", "folds")
    best = backtest(series).groupBy(*KEYS, "n", "season").agg(F.min_by(key, F.struct("mape", "ord")).alias("w"))
    best = best.select(*KEYS, "n", "season", F.col("w.model").alias("model"), F.col("w.mape").alias("mape"), F.col("w.folds").alias("folds")).where(F.col("mape") <= MAX_MAPE)

    def inside(f: Column) -> Column:
        low, high = interval(f["predicted"], F.col("mape"))
        return f["actual"].between(low, high)

    return best.withColumns({"interval_hits": F.size(F.filter("folds", inside)), "interval_folds": F.size("folds")}).drop("folds")


def forecasts(series: DataFrame, horizon: int = 3, min_points: int = 8) -> DataFrame:
    """[W-18 to W-24] Published forecasts of the simple candidates."""
    c = candidates(series).withColumn("n", F.count("*").over(whole()))
    past = F.collect_list("tonnage_kg").over(ordered().rowsBetween(-11, 0))
    last = c.withColumn("_season", past).where((F.col("i") == F.col("n")) & (F.col("n") >= min_points)).drop("n", "season")
    w = winners(series)
    joined = last.join(w, KEYS).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    seasonal = F.when((F.col("season") == 12) & (F.size("_season") == 12), F.get("_season", (F.col("h") - 1) % 12)).otherwise(F.col("naive"))
    point = F.when(F.col("model") == "naive", F.col("naive")).when(F.col("model") == "drift", F.col("tonnage_kg") + F.col("slope") * F.col("h")).when(F.col("model") == "recent_mean", F.col("recent_mean")).otherwise(seasonal)
    low, high = interval(point, F.col("mape"))
    return joined.select(*KEYS, periods.next_label(F.col("period"), F.col("h")).alias("period"), F.col("h").alias("horizon"), F.round(F.greatest(F.lit(0.0), point), 3).alias("predicted_kg"), F.round(low, 3).alias("lower_kg"), F.round(high, 3).alias("upper_kg"), "model", F.col("mape").alias("backtest_mape"), "interval_hits", "interval_folds")


def eligible(series: DataFrame) -> DataFrame:
    """[W-1] Series with enough points that haven't stopped."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("sort_key"))
    ranked = series.withColumn("rn", F.row_number().over(newest))
    return ranked.groupBy(*KEYS).agg(F.count("*").alias("points"), F.sum(F.when(F.col("rn") <= 3, F.col("tonnage_kg")).otherwise(0.0)).alias("recent_kg")).where("points >= 8 and recent_kg > 0")


# ---- labels


def rule_labels(series: DataFrame, broken: DataFrame, human: DataFrame) -> DataFrame:
    """[W-25] Labels that need no judgement: GENUINE where a service starts or
    stops, SPURIOUS where the published parts of a period (``broken``: entity_key,
    period) don't sum, among points with a full window on both sides. Keys that a
    person has labelled (``human``) are left alone."""
    key = ["grain", "entity_key", "direction", "period"]
    near = lambda a, b: F.count("*").over(ordered().rowsBetween(a, b))
    full = series.withColumns({"_b": near(-3, -1), "_a": near(1, 3)}).where("_b = 3 and _a = 3")
    moved = structural(series).select(*key, F.lit("GENUINE").alias("label"), F.col("method").alias("basis"))
    odd = full.join(broken.select("entity_key", "period").distinct(), ["entity_key", "period"], "left_semi").join(moved, key, "left_anti")
    found = moved.unionByName(odd.select(*key, F.lit("SPURIOUS").alias("label"), F.lit("parts do not sum").alias("basis")))
    return found.join(human.select(*key), key, "left_anti").groupBy(*key).agg(F.min("label").alias("label"), F.min("basis").alias("basis"))


def pending(alerts: DataFrame, labels: DataFrame, most: int = 40) -> DataFrame:
    """[G-13, J-13] Alerts that no label of their direction judges, largest first."""
    key = ["grain", "entity_key", "direction", "period"]
    left = alerts.join(labels.select(*key), key, "left_anti")
    return left.orderBy(F.col("observed_kg").desc_nulls_last(), *key, "measure").limit(most)


def judged(labels: DataFrame, alerts: DataFrame, material: Column) -> DataFrame:
    """[A-15, A-24, J-18] The detector against labels: one row of counts,
    precision, recall of all events and of the material ones. Directions of an
    event are one, genuine if any is."""
    key = ["grain", "entity_key", "period"]
    one = labels.groupBy(*key).agg(F.bool_or(F.col("label") == "GENUINE").alias("genuine"), F.bool_or(material).alias("material"))
    both = one.join(alerts.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    g, h, m = F.col("genuine"), F.col("hit"), F.col("material")
    counts = both.agg(F.count_if(g & h).alias("tp"), F.count_if(~g & h).alias("fp"), F.count_if(g & ~h).alias("fn"), F.count_if(g & m & h).alias("tpm"), F.count_if(g & m).alias("gm"))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return counts.select("tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_"), share(F.col("tpm"), F.col("gm")).alias("recall_material"))
