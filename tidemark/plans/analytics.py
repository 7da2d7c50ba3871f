"""Registered queries: governed metrics, series, anomalies, forecasts and
market structure, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import kernels, series, structure, warehouse
from tidemark.plans import proxy
from tidemark.plans.registry import query
from tidemark.plans.semantic import QuerySpec, citations, compile_query

_MONTHLY = {"grain": "AIRPORT", "direction": "TOTAL", "period": "2001-07"}


@query("rankings_tonnage", f"""WITH {proxy.FACT} SELECT airport_iata, airport_name, sum(tonnage_kg) / 1000.0 AS tonnage_mt,
  CASE WHEN sum(prior_year_tonnage_kg) > 0 THEN (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100.0 END AS growth_yoy_pct
  FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2001-07' GROUP BY ALL ORDER BY tonnage_mt DESC, 1, 2 LIMIT 20""")
def rankings_tonnage(spark, d):
    """[A-1, L-1, F-1 to F-3]"""
    return compile_query(QuerySpec(["tonnage_mt", "growth_yoy_pct"], ["airport_iata", "airport_name"], _MONTHLY, "tonnage_mt", True, 20), proxy.facts(spark, d, _MONTHLY["period"]))


@query("rankings_growth_floor", f"""WITH {proxy.FACT} SELECT airport_iata, CASE WHEN sum(prior_year_tonnage_kg) > 0 THEN (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100.0 END AS growth_yoy_pct, count(*) AS record_count
  FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2001-07' AND tonnage_kg >= 100000 GROUP BY ALL ORDER BY growth_yoy_pct DESC NULLS LAST, 1 LIMIT 20""")
def rankings_growth_floor(spark, d):
    """[F-8, L-1] The floor is on rows."""
    return compile_query(QuerySpec(["growth_yoy_pct", "record_count"], ["airport_iata"], {**_MONTHLY, "min_tonnage_kg": 100_000}, "growth_yoy_pct", True, 20), proxy.facts(spark, d, _MONTHLY["period"]))


@query("entity_trend_series", f"""WITH {proxy.FACT} SELECT period, sum(tonnage_kg) AS tonnage_kg, count(DISTINCT source_document_id) AS source_count FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND airport_iata = 'N07'
  AND sort_key >= (SELECT min(sort_key) FROM fact WHERE period = '1998-01') GROUP BY ALL ORDER BY period LIMIT 60""")
def entity_trend_series(spark, d):
    """[F-3 period_from, A-7] One airport's history, ascending by label. The scalar
    of ``period_from`` is taken over the whole view."""
    facts = proxy.kept(proxy.facts(spark, d))
    return compile_query(QuerySpec(["tonnage_kg", "source_count"], ["period"], {"period_from": "1998-01", "grain": "AIRPORT", "direction": "TOTAL", "airport_iata": "N07"}, "period", False, 60), facts)


@query("carrier_share_excl_aggregate", f"""WITH {proxy.FACT} SELECT airline_name, measure, sum(tonnage_kg) / 1000.0 AS tonnage_mt FROM fact WHERE grain = 'AIRLINE' AND (is_aggregate IS NULL OR NOT is_aggregate) AND calendar_year = 2000 GROUP BY ALL ORDER BY tonnage_mt DESC, 1, 2 LIMIT 1000""")
def carrier_share(spark, d):
    """[F-5] Carriers without the industry row."""
    return compile_query(QuerySpec(["tonnage_mt"], ["airline_name", "measure"], {"grain": "AIRLINE", "exclude_aggregate_airlines": True, "calendar_year": 2000}, "tonnage_mt", True, 1000), proxy.facts(spark, d))


@query("metric_dimensions", f"""WITH {proxy.FACT} SELECT country, period_kind, calendar_year, direction, publisher, sum(tonnage_kg) AS tonnage_kg, sum(prior_year_tonnage_kg) / 1000.0 AS prior_year_tonnage_mt, count(*) AS record_count
  FROM fact WHERE grain = 'AIRPORT' AND country = '1' AND publisher = '1-URGENT' AND period_kind = 'MONTH' GROUP BY ALL ORDER BY record_count DESC, country, period_kind, calendar_year, direction, publisher LIMIT 500""")
def metric_dimensions(spark, d):
    """[F-2, F-3] The other dimensions and filters."""
    return compile_query(QuerySpec(["tonnage_kg", "prior_year_tonnage_mt", "record_count"], ["country", "period_kind", "calendar_year", "direction", "publisher"], {"grain": "AIRPORT", "country": "1", "publisher": "1-URGENT", "period_kind": "MONTH"}, "record_count", True, 500), proxy.facts(spark, d))


@query("health_counts", f"""WITH {proxy.FACT} SELECT count(*) AS facts, count(DISTINCT airport_iata) AS airports, count(DISTINCT airline_name) AS airlines, count(DISTINCT period) AS periods, count(DISTINCT source_document_id) AS documents, max(period) AS latest FROM fact""")
def health_counts(spark, d):
    """[A-7, A-14, L-2, P-3]"""
    return proxy.facts(spark, d).agg(F.count("*").alias("facts"), *[F.countDistinct(c).alias(a) for c, a in (("airport_iata", "airports"), ("airline_name", "airlines"), ("period", "periods"), ("source_document_id", "documents"))], F.max("period").alias("latest"))


@query("latest_period_by_grain", f"WITH {proxy.FACT} SELECT grain, arg_max(period, sort_key) AS period, max(sort_key) AS sort_key FROM fact GROUP BY grain")
def latest_period(spark, d):
    """[L-2]"""
    return proxy.facts(spark, d).groupBy("grain").agg(F.max_by("period", "sort_key").alias("period"), F.max("sort_key").alias("sort_key"))


@query("fact_star_view", f"WITH {proxy.FACT} SELECT grain, airport_iata, airport_name, country, airline_name, is_aggregate, period, direction, publisher, measure, tonnage_kg, source_document_id, prior_year_tonnage_kg, period_kind, calendar_year, calendar_month, sort_key FROM fact")
def fact_star_view(spark, d):
    """[J-1]"""
    return proxy.facts(spark, d)


@query("source_fact_counts", f"""WITH {proxy.FACT}, doc AS (SELECT o_orderkey AS source_document_id, o_orderpriority AS publisher FROM orders)
  SELECT publisher, count(*) AS documents, sum(n) AS facts FROM (SELECT doc.publisher, doc.source_document_id, count(fact.grain) AS n FROM doc LEFT JOIN fact USING (source_document_id) GROUP BY ALL) GROUP BY publisher""")
def source_fact_counts(spark, d):
    """[J-5, A-11] Documents without facts count too. Facts are counted by
    document before the join."""
    counts = proxy.facts(spark, d).groupBy("source_document_id").agg(F.count("*").alias("n"))
    docs = proxy.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_document_id"), F.col("o_orderpriority").alias("publisher"))
    return docs.join(counts, "source_document_id", "left").groupBy("publisher").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(0))).alias("facts"))


@query("citations_semijoin", f"WITH {proxy.FACT} SELECT o_orderkey AS source_document_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT source_document_id FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2001-07') ORDER BY 1 LIMIT 12")
def citations_semijoin(spark, d):
    """[J-11, G-11]"""
    docs = proxy.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_document_id"), F.col("o_orderstatus").alias("status"))
    return citations(proxy.facts(spark, d, _MONTHLY["period"]), docs, _MONTHLY)


_LABELS = """labels_ AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-FY' WHEN 2 THEN strftime(o_orderdate, '%Y') || '-A' ELSE 'unknown' END AS period FROM orders)"""


@query("period_attributes", f"""WITH {_LABELS}, k AS (SELECT *, CASE WHEN regexp_matches(period, '^\\d{{4}}-(0[1-9]|1[0-2])$') THEN 'MONTH' WHEN period LIKE '____-FY' THEN 'FISCAL' ELSE 'ANNUAL' END AS kind FROM labels_)
  SELECT id, period, kind, CASE WHEN period = 'unknown' THEN 1900 ELSE CAST(period[1:4] AS INTEGER) END AS calendar_year, CASE WHEN kind = 'MONTH' THEN CAST(period[6:7] AS INTEGER) END AS calendar_month,
  CASE kind WHEN 'MONTH' THEN CAST(period[1:4] AS INTEGER) - CASE WHEN CAST(period[6:7] AS INTEGER) < 4 THEN 1 ELSE 0 END WHEN 'FISCAL' THEN CAST(period[1:4] AS INTEGER) END AS fiscal_start,
  CASE WHEN period = 'unknown' THEN 0 ELSE CAST(period[1:4] AS INTEGER) * 100 + CASE kind WHEN 'MONTH' THEN CAST(period[6:7] AS INTEGER) WHEN 'FISCAL' THEN 6 ELSE 12 END END AS sort_key,
  CASE kind WHEN 'MONTH' THEN strftime(CAST(period || '-01' AS DATE) + INTERVAL 5 MONTH, '%Y-%m') WHEN 'FISCAL' THEN CAST(CAST(period[1:4] AS INTEGER) + 5 AS VARCHAR) || '-FY' ELSE CAST(CASE WHEN period = 'unknown' THEN 1900 ELSE CAST(period[1:4] AS INTEGER) END + 5 AS VARCHAR) || CASE WHEN period = 'unknown' THEN 'own' ELSE '-A' END END AS later FROM k""")
def period_attributes(spark, d):
    """[N-12, W-24]"""
    o = proxy.table(spark, d, "orders")
    y, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 4
    p = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, F.concat(y, F.lit("-FY"))).when(k == 2, F.concat(y, F.lit("-A"))).otherwise("unknown")
    o = o.select(F.col("o_orderkey").alias("id"), p.alias("period"))
    c = F.col("period")
    return o.select("id", "period", periods.kind(c).alias("kind"), periods.year(c).alias("calendar_year"), periods.month(c).alias("calendar_month"), periods.fiscal_start(c).alias("fiscal_start"), periods.sort_key(c).alias("sort_key"), periods.next_label(c, 5).alias("later"))


@query("series_builder", f"WITH {proxy.SERIES} SELECT * FROM series WHERE n_points >= 24")
def series_builder(spark, d):
    """[A-2]"""
    return series.build(proxy.series_facts(spark, d), 24)


@query("national_totals", f"WITH {proxy.FACT} SELECT period, direction, sum(tonnage_kg) AS total_kg FROM fact WHERE grain = 'AIRPORT' GROUP BY ALL")
def national_totals(spark, d):
    """[A-3]"""
    return series.national_totals(proxy.facts(spark, d))


_TREND = f"""{proxy.SERIES}, totals AS (SELECT period, direction, sum(tonnage_kg) AS total_kg FROM fact WHERE grain = 'AIRPORT' AND period < '2001-08' GROUP BY ALL),
  t AS (SELECT s.*, total_kg, row_number() OVER w - 1 AS i, first_value(tonnage_kg) OVER w AS v0, lag(tonnage_kg) OVER w AS v1, lag(tonnage_kg, 12) OVER w AS v12, lag(tonnage_kg / total_kg * 100, 12) OVER w AS share12
  FROM series s LEFT JOIN totals USING (period, direction) WINDOW w AS (PARTITION BY grain, entity_key, s.direction, measure ORDER BY sort_key))"""


@query("trend_growth_share", f"""WITH {_TREND} SELECT grain, entity_key, direction, measure, period, sort_key, tonnage_kg,
  coalesce(round((tonnage_kg - prior_kg) / nullif(prior_kg, 0) * 100, 2), round((tonnage_kg - v12) / nullif(v12, 0) * 100, 2)) AS yoy_pct, round((tonnage_kg - v1) / nullif(v1, 0) * 100, 2) AS mom_pct,
  CASE WHEN i >= 1 AND v0 > 0 THEN round((pow(tonnage_kg / v0, 1.0 / i) - 1) * 100, 2) END AS cagr_pct, round(tonnage_kg / total_kg * 100, 3) AS share_of_total, CASE WHEN round(round(tonnage_kg / total_kg * 100, 3) - share12, 3) = 0 THEN 0.0 ELSE round(round(tonnage_kg / total_kg * 100, 3) - share12, 3) END AS share_shift_pp FROM t""")
def trend_growth_share(spark, d):
    """[W-2 to W-7]"""
    facts = proxy.kept(proxy.series_facts(spark, d))
    return series.trend(series.build(facts), series.national_totals(facts))


_GLOBAL = """g0 AS (SELECT *, quantile_cont(tonnage_kg, 0.5) OVER p AS global_median, avg(tonnage_kg) OVER p AS mean_, stddev_pop(tonnage_kg) OVER p AS sd_ FROM {src} WINDOW p AS (PARTITION BY grain, entity_key, direction, measure)),
  g AS (SELECT *, CASE WHEN mad_ <> 0 THEN 0.6745 * (tonnage_kg - global_median) / mad_ WHEN sd_ <> 0 THEN (tonnage_kg - mean_) / sd_ ELSE 0 END AS global_z FROM (
    SELECT *, quantile_cont(abs(tonnage_kg - global_median), 0.5) OVER (PARTITION BY grain, entity_key, direction, measure) AS mad_ FROM g0))"""
_LOCAL = _GLOBAL + """, l0 AS (SELECT *, list(tonnage_kg) OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM g),
  l1 AS (SELECT *, list_aggregate(past, 'median') AS med FROM l0), l2 AS (SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'median') AS mad, list_aggregate(past, 'stddev_pop') AS sd, list_aggregate(past, 'avg') AS mn FROM l1),
  l AS (SELECT *, CASE WHEN len(past) >= 6 AND mad <> 0 THEN 0.6745 * (tonnage_kg - med) / mad WHEN len(past) >= 6 AND sd <> 0 THEN (tonnage_kg - mn) / sd ELSE global_z END AS z,
    CASE WHEN len(past) >= 6 AND (mad <> 0 OR sd <> 0) THEN med ELSE global_median END AS baseline_kg FROM l2)"""


@query("global_robust_z", f"WITH {proxy.SERIES}, {_GLOBAL.format(src='series')} SELECT grain, entity_key, direction, measure, period, global_median, global_z AS z FROM g")
def global_robust_z(spark, d):
    """[W-8]"""
    return series.global_robust_z(series.build(proxy.series_facts(spark, d))).select(*series.KEYS, "period", "global_median", F.col("global_z").alias("z"))


@query("local_robust_z", f"WITH {proxy.SERIES}, {_LOCAL.format(src='series')} SELECT grain, entity_key, direction, measure, period, baseline_kg, z FROM l")
def local_robust_z(spark, d):
    """[W-9]"""
    return series.local_robust_z(series.build(proxy.series_facts(spark, d))).select(*series.KEYS, "period", "baseline_kg", "z")


_STAT = f"""{proxy.SERIES}, trim_ AS (SELECT * FROM (SELECT *, max(tonnage_kg) OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key) AS seen FROM series) WHERE seen > 0), {_LOCAL.format(src='trim_')},
  guard AS (SELECT *, count(*) OVER p AS n_, avg(CASE WHEN tonnage_kg > 0 THEN 1.0 ELSE 0.0 END) OVER p AS some_, max(tonnage_kg) OVER p AS peak_ FROM l WINDOW p AS (PARTITION BY grain, entity_key, direction, measure)),
  stat AS (SELECT grain, entity_key, direction, measure, period, sort_key, tonnage_kg AS observed_kg, baseline_kg AS expected_kg, round((tonnage_kg - baseline_kg) / nullif(baseline_kg, 0) * 100, 2) AS deviation_pct, round(z, 3) AS z_score, 'robust_z' AS method,
    CASE WHEN abs(z) >= 4 THEN 'HIGH' WHEN abs(z) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM guard WHERE n_ >= 6 AND some_ >= 0.5 AND global_median >= 10000 AND global_median / peak_ >= 0.15 AND abs(z) >= 3 AND tonnage_kg >= 1000)"""


@query("statistical_anomalies", f"WITH {_STAT} SELECT * FROM stat")
def statistical_anomalies(spark, d):
    """[W-10 to W-12]"""
    return series.statistical(series.build(proxy.series_facts(spark, d)))


_STRUCT = f"""{proxy.SPARSE}, s0 AS (SELECT *, list(tonnage_kg) OVER (PARTITION BY entity_key ORDER BY sort_key ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, list(tonnage_kg) OVER (PARTITION BY entity_key ORDER BY sort_key ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM sparse),
  s1 AS (SELECT *, list_max(b) = 0 AND list_min(a) > 0 AS started, list_min(b) > 0 AND list_max(a) = 0 AS stopped FROM s0 WHERE len(a) = 3 AND len(b) = 3 AND tonnage_kg > 0),
  struct_ AS (SELECT entity_key, period, sort_key, tonnage_kg AS observed_kg, CASE WHEN started THEN 0.0 ELSE list_aggregate(b, 'median') END AS expected_kg, CASE WHEN started THEN 'service_started' ELSE 'service_stopped' END AS method,
    CASE WHEN list_aggregate(CASE WHEN started THEN a ELSE b END, 'median') >= 1000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s1 WHERE started OR stopped)"""


@query("structural_transitions", f"WITH {_STRUCT} SELECT * FROM struct_")
def structural_transitions(spark, d):
    """[W-15]"""
    return series.structural(proxy.sparse(spark, d)).select("entity_key", "period", "sort_key", "observed_kg", "expected_kg", "method", "severity")


@query("material_alerts_deduped", f"""WITH {_STAT} SELECT grain, entity_key, period, direction, measure, observed_kg, expected_kg, deviation_pct, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY grain, entity_key, period ORDER BY abs(deviation_pct) DESC NULLS LAST, direction, measure) AS r FROM stat WHERE greatest(observed_kg, expected_kg) / 1000 >= 500 AND abs(deviation_pct) >= 25) WHERE r = 1""")
def material_alerts(spark, d):
    """[F-10, W-17]"""
    alerts = series.statistical(series.build(proxy.series_facts(spark, d))).where(series.is_material())
    return series.one_alert(alerts).select("grain", "entity_key", "period", "direction", "measure", "observed_kg", "expected_kg", "deviation_pct", "severity")


@query("alerts_per_month", f"WITH {_STAT} SELECT count(*) AS months, avg(n) AS alerts_per_month FROM (SELECT period, count(*) AS n FROM stat GROUP BY period)")
def alerts_per_month(spark, d):
    """[A-22] Over months that have an alert."""
    return series.statistical(series.build(proxy.series_facts(spark, d))).groupBy("period").agg(F.count("*").alias("n")).agg(F.count("*").alias("months"), F.avg("n").alias("alerts_per_month"))


@query("alert_ranking", f"WITH {_STAT} SELECT grain, entity_key, direction, measure, period, deviation_pct, z_score FROM stat ORDER BY abs(deviation_pct) DESC NULLS LAST, grain, entity_key, direction, measure, period LIMIT 25")
def alert_ranking(spark, d):
    """[L-3, P-10]"""
    s = series.statistical(series.build(proxy.series_facts(spark, d)))
    return s.orderBy(F.col("method").startswith("service_").desc(), F.abs("deviation_pct").desc_nulls_last(), *series.KEYS, "period").limit(25).select(*series.KEYS, "period", "deviation_pct", "z_score")


_CAND = f"""{proxy.SERIES}, c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY grain, entity_key, direction, measure) AS n, tonnage_kg AS naive,
  CASE WHEN row_number() OVER w >= 2 THEN (tonnage_kg - first_value(tonnage_kg) OVER w) / (row_number() OVER w - 1) ELSE 0.0 END AS slope, avg(tonnage_kg) OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS recent_mean,
  CASE WHEN row_number() OVER w >= 12 THEN lag(tonnage_kg, 11) OVER w ELSE tonnage_kg END AS seasonal_naive FROM series WINDOW w AS (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key)), cd AS (SELECT *, naive + slope AS drift FROM c)"""
_TEST = f"""{_CAND}, f0 AS (SELECT *, lag(naive) OVER w AS p0, lag(drift) OVER w AS p1, lag(recent_mean) OVER w AS p2, lag(seasonal_naive) OVER w AS p3 FROM cd WINDOW w AS (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key)),
  f1 AS (SELECT grain, entity_key, direction, measure, n, tonnage_kg AS actual, unnest([0, 1, 2, 3]) AS ord, unnest(['naive', 'drift', 'recent_mean', 'seasonal_naive']) AS model, unnest([p0, p1, p2, p3]) AS predicted, unnest([2, 3, 3, 12]) AS need FROM f0 WHERE n >= 6 AND i > n - 3),
  bt AS (SELECT grain, entity_key, direction, measure, n, ord, model, round(avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100, 2) AS mape, list({{'a': actual, 'p': predicted}}) AS folds FROM f1 WHERE n >= need + 3 GROUP BY ALL),
  win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY mape, ord) AS r FROM bt WHERE mape IS NOT NULL) WHERE r = 1 AND mape <= 35),
  best AS (SELECT grain, entity_key, direction, measure, model, mape, len(folds) AS interval_folds, len(list_filter(folds, lambda x: x.a BETWEEN greatest(0.0, x.p - 1.7 * greatest(abs(x.p) * mape / 100, abs(x.p) * 0.02)) AND x.p + 1.7 * greatest(abs(x.p) * mape / 100, abs(x.p) * 0.02))) AS interval_hits FROM win)"""


@query("forecast_candidates", f"WITH {_CAND} SELECT grain, entity_key, direction, measure, period, naive, round(drift, 4) AS drift, round(recent_mean, 4) AS recent_mean, seasonal_naive FROM cd")
def forecast_candidates(spark, d):
    """[W-18]"""
    return series.candidates(series.build(proxy.series_facts(spark, d))).select(*series.KEYS, "period", "naive", F.round("drift", 4).alias("drift"), F.round("recent_mean", 4).alias("recent_mean"), "seasonal_naive")


@query("rolling_backtest_mape", f"WITH {_TEST} SELECT grain, entity_key, direction, measure, model, mape FROM bt WHERE mape IS NOT NULL")
def rolling_backtest_mape(spark, d):
    """[W-20, A-25]"""
    return series.backtest(series.build(proxy.series_facts(spark, d))).select(*series.KEYS, "model", "mape")


@query("forecast_published", f"""WITH {_TEST}, last_ AS (SELECT *, list(tonnage_kg) OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ss FROM cd),
  p AS (SELECT l.grain, l.entity_key, l.direction, l.measure, l.period AS at_, h, b.model, b.mape, interval_hits, interval_folds, CASE b.model WHEN 'naive' THEN naive WHEN 'drift' THEN tonnage_kg + slope * h WHEN 'recent_mean' THEN recent_mean ELSE CASE WHEN len(ss) = 12 THEN ss[h] ELSE naive END END AS pt
    FROM last_ l JOIN best b USING (grain, entity_key, direction, measure) CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) WHERE i = n AND n >= 8)
  SELECT grain, entity_key, direction, measure, strftime(CAST(at_ || '-01' AS DATE) + to_months(h), '%Y-%m') AS period, h AS horizon, round(greatest(0.0, pt), 3) AS predicted_kg, round(greatest(0.0, pt - 1.7 * greatest(abs(pt) * mape / 100, abs(pt) * 0.02)), 3) AS lower_kg,
    round(pt + 1.7 * greatest(abs(pt) * mape / 100, abs(pt) * 0.02), 3) AS upper_kg, model, mape AS backtest_mape, interval_hits, interval_folds FROM p""")
def forecast_published(spark, d):
    """[W-21 to W-24]"""
    return series.forecasts(proxy.kept(series.build(proxy.series_facts(spark, d))))


@query("interval_coverage", f"WITH {_TEST} SELECT count(*) AS series, round(median(mape), 4) AS median_mape, sum(interval_hits) AS hits, sum(interval_folds) AS folds, round(100.0 * sum(interval_hits) / sum(interval_folds), 4) AS coverage_pct FROM best")
def interval_coverage(spark, d):
    """[W-23, A-23]"""
    w = series.winners(series.build(proxy.series_facts(spark, d)))
    return w.agg(F.count("*").alias("series"), F.round(F.median("mape"), 4).alias("median_mape"), F.sum("interval_hits").alias("hits"), F.sum("interval_folds").alias("folds"), F.round(F.try_divide(100.0 * F.sum("interval_hits"), F.sum("interval_folds")), 4).alias("coverage_pct"))


@query("eligible_series", f"WITH {proxy.SERIES} SELECT grain, entity_key, direction, measure, count(*) AS points, sum(CASE WHEN rn <= 3 THEN tonnage_kg ELSE 0 END) AS recent_kg FROM (SELECT *, row_number() OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key DESC) AS rn FROM series) GROUP BY ALL HAVING count(*) >= 8 AND sum(CASE WHEN rn <= 3 THEN tonnage_kg ELSE 0 END) > 0")
def eligible_series(spark, d):
    """[W-1]"""
    return series.eligible(series.build(proxy.series_facts(spark, d)))


_RECENT = "(SELECT period FROM (SELECT DISTINCT period FROM fact WHERE regexp_matches(period, '^\\d{4}-\\d{2}$') AND period < '2001-08') ORDER BY period DESC LIMIT 12)"


@query("concentration_hhi", f"""WITH {proxy.FACT}, e AS (SELECT period, airport_iata, sum(tonnage_kg) AS v FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period IN {_RECENT} GROUP BY ALL), s AS (SELECT *, 100 * v / sum(v) OVER (PARTITION BY period) AS share FROM e WHERE v > 0)
  SELECT period, count(*) AS entities, CAST(round(sum(share * share)) AS BIGINT) AS hhi, round(10000 / sum(share * share), 1) AS effective_n, round(max(share), 1) AS top_share_pct, CASE WHEN sum(share * share) < 1500 THEN 'unconcentrated' WHEN sum(share * share) < 2500 THEN 'moderately concentrated' ELSE 'highly concentrated' END AS interpretation FROM s GROUP BY period""")
def concentration_hhi(spark, d):
    """[A-16, L-6, J-15, F-6]"""
    f = proxy.facts(spark, d).where("grain = 'AIRPORT' and direction = 'TOTAL' and period < '2001-08'").where(F.col("period").rlike(r"^\d{4}-\d{2}$"))
    f = proxy.kept(f.select("period", "airport_iata", "tonnage_kg"))
    e = f.groupBy("period", "airport_iata").agg(F.sum("tonnage_kg").alias("v"))
    recent = f.select("period").distinct().orderBy(F.desc("period")).limit(12)
    return structure.concentration(e.join(recent, "period", "left_semi"), ["period"], "v")


_ATTR = """{fact}, n AS (SELECT airport_iata AS entity_key, sum(tonnage_kg) / 1000 AS mt FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2001-07' GROUP BY ALL), t AS (SELECT airport_iata AS entity_key, sum(tonnage_kg) / 1000 AS mt FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2000-07' GROUP BY ALL),
  j AS (SELECT coalesce(n.entity_key, t.entity_key) AS entity_key, coalesce(n.mt, 0.0) AS now_mt, coalesce(t.mt, 0.0) AS then_mt FROM n FULL JOIN t ON n.entity_key = t.entity_key)"""


@query("growth_attribution", f"""WITH {_ATTR.format(fact=proxy.FACT)} SELECT entity_key, now_mt, then_mt, now_mt - then_mt AS change_mt, round(100 * (now_mt - then_mt) / (SELECT sum(then_mt) FROM j), 8) AS contribution_pp, round(100 * abs(now_mt - then_mt) / (SELECT sum(abs(now_mt - then_mt)) FROM j), 8) AS share_of_change_pct
  FROM j WHERE now_mt <> then_mt ORDER BY abs(now_mt - then_mt) DESC, entity_key LIMIT 12""")
def growth_attribution(spark, d):
    """[A-19, J-17, L-7, U-2]"""
    f = proxy.kept(proxy.facts(spark, d, "2001-07").where("grain = 'AIRPORT' and direction = 'TOTAL'"))
    at = lambda p: f.where(F.col("period") == p).groupBy(F.col("airport_iata").alias("entity_key")).agg((F.sum("tonnage_kg") / 1000).alias("mt"))
    out = structure.attribution(at("2001-07"), at("2000-07"))
    return out.withColumns({c: F.round(c, 8) for c in ("contribution_pp", "share_of_change_pct")})


_EFF = f"""{proxy.METRIC}, wide AS (SELECT grain, entity_key, period, sort_key, direction, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in ('ftk_million', 'atk_million', 'freight_tonnes', 'mail_tonnes', 'cargo_total_tonnes', 'departures', 'pax_carried', 'pax_load_factor', 'block_hours'))} FROM metric WHERE grain = 'AIRLINE' GROUP BY ALL),
  eff AS (SELECT *, round(100.0 * ftk_million / nullif(atk_million, 0), 2) AS cargo_load_factor_pct, round(freight_tonnes / nullif(departures, 0), 3) AS tonnes_per_departure, round(100.0 * mail_tonnes / nullif(cargo_total_tonnes, 0), 2) AS mail_share_pct, round(freight_tonnes / nullif(pax_carried, 0) * 1000, 3) AS kg_freight_per_pax FROM wide)"""
_EFF_COLS = "grain, entity_key, period, sort_key, direction, freight_tonnes, departures, pax_carried, cargo_load_factor_pct, tonnes_per_departure, mail_share_pct, kg_freight_per_pax"


@query("carrier_efficiency_pivot", f"WITH {_EFF} SELECT {_EFF_COLS} FROM eff")
def carrier_efficiency_pivot(spark, d):
    """[A-4, A-5, J-9]"""
    return structure.carrier_efficiency(proxy.metrics(spark, d, "AIRLINE")).select(*_EFF_COLS.split(", "))


@query("belly_dependency", f"""WITH {_EFF} SELECT entity_key, count(*) AS months, CASE WHEN NOT bool_or(pax_carried > 0) THEN 'freighter' WHEN round(avg(tonnes_per_departure), 2) >= 5 THEN 'freighter' ELSE 'belly' END AS kind,
  CASE WHEN count(*) FILTER (pax_carried > 0) >= 4 THEN round(corr(freight_tonnes, pax_carried) FILTER (pax_carried > 0), 3) END AS correlation, round(avg(cargo_load_factor_pct), 1) AS mean_load_factor_pct, round(avg(tonnes_per_departure), 2) AS mean_tonnes_per_departure FROM eff WHERE freight_tonnes IS NOT NULL GROUP BY entity_key""")
def belly_dependency(spark, d):
    """[A-17, A-18]"""
    return structure.belly_dependency(structure.carrier_efficiency(proxy.metrics(spark, d, "AIRLINE")))


_AEFF = f"""{proxy.FACT}, {proxy.METRIC_ONLY}, fr AS (SELECT airport_iata, period, sort_key, direction, sum(tonnage_kg) / 1000 AS mt FROM fact WHERE grain = 'AIRPORT' GROUP BY ALL),
  ops AS (SELECT entity_key, period, direction, max(value) FILTER (metric = 'pax_carried') AS pax, max(value) FILTER (metric = 'aircraft_movements') AS movements FROM metric WHERE grain = 'AIRPORT' GROUP BY ALL),
  ae AS (SELECT airport_iata, n_name AS airport_name, fr.period, sort_key, fr.direction, round(mt, 1) AS freight_mt, movements, pax, round(mt / nullif(movements, 0), 3) AS tonnes_per_flight, round(mt * 1000 / nullif(pax, 0), 2) AS kg_per_pax, round(pax / nullif(movements, 0), 1) AS pax_per_flight
  FROM fr JOIN ops ON airport_iata = entity_key AND fr.period = ops.period AND fr.direction = ops.direction LEFT JOIN nation ON airport_iata = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'))"""


@query("airport_efficiency", f"WITH {_AEFF} SELECT * FROM ae")
def airport_efficiency(spark, d):
    """[A-6, J-10, L-4]"""
    return structure.airport_efficiency(proxy.facts(spark, d), proxy.metrics(spark, d, "AIRPORT"), proxy.airports(spark, d))


@query("growth_decomposition", f"""WITH {_AEFF}, a AS (SELECT *, count(*) OVER p AS n, max(sort_key) OVER p AS last FROM ae WHERE tonnes_per_flight IS NOT NULL WINDOW p AS (PARTITION BY airport_iata, direction)),
  j AS (SELECT x.airport_iata, x.direction, x.period AS period_now, y.period AS period_then, x.freight_mt - y.freight_mt AS df, y.freight_mt AS f0, (x.movements - y.movements) * y.tonnes_per_flight AS fl FROM a x JOIN ae y ON x.airport_iata = y.airport_iata AND x.direction = y.direction AND y.period = CAST(CAST(x.period[1:4] AS INTEGER) - 1 AS VARCHAR) || x.period[5:7] AND y.tonnes_per_flight IS NOT NULL WHERE x.n >= 13 AND x.sort_key = x.last)
  SELECT airport_iata, direction, period_now, period_then, round(df, 1) AS change_mt, round(100.0 * df / nullif(f0, 0), 2) AS change_pct, round(fl, 1) AS more_flights_mt, round(df - fl, 1) AS fuller_flights_mt, CASE WHEN abs(fl) > abs(df - fl) THEN 'more flights' ELSE 'fuller flights' END AS driver FROM j""")
def growth_decomposition(spark, d):
    """[A-20, J-16]"""
    return structure.growth_decomposition(proxy.kept(structure.airport_efficiency(proxy.facts(spark, d), proxy.metrics(spark, d, "AIRPORT"), proxy.airports(spark, d))))


@query("metric_catalogue", f"WITH {proxy.METRIC} SELECT metric, count(*) AS observations, count(DISTINCT entity_key) AS entities, min(period) AS first_period, max(period) AS last_period FROM metric GROUP BY metric")
def metric_catalogue(spark, d):
    """[A-12]"""
    return proxy.metrics(spark, d).groupBy("metric").agg(F.count("*").alias("observations"), F.countDistinct("entity_key").alias("entities"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query("component_identity", f"""WITH {proxy.FACT}, g AS (SELECT airport_iata, period, sum(tonnage_kg) FILTER (direction = 'INTERNATIONAL') AS i, sum(tonnage_kg) FILTER (direction = 'DOMESTIC') AS dm, sum(tonnage_kg) FILTER (direction = 'TOTAL') AS t FROM fact WHERE grain = 'AIRPORT' GROUP BY ALL)
  SELECT count(*) AS triples, count(*) FILTER (abs(i + dm - t) <= greatest(1.0, 0.001 * t)) AS holds, count(*) FILTER (abs(i + dm - t) > 0.05 * t) AS broken, max(abs(i + dm - t)) AS worst_kg FROM g WHERE i IS NOT NULL AND dm IS NOT NULL AND t IS NOT NULL""")
def component_identity(spark, d):
    """[A-21]"""
    c = structure.component_identity(proxy.facts(spark, d))
    return c.agg(F.count("*").alias("triples"), F.count_if("holds").alias("holds"), F.count_if("broken").alias("broken"), F.max("mismatch_kg").alias("worst_kg"))


_CHAIN = f"""{proxy.FACT}, m AS (SELECT direction AS section, airport_iata AS entity_key, period, sum(tonnage_kg) / 1000 AS month_mt FROM fact WHERE grain = 'AIRPORT' GROUP BY ALL),
  fy AS (SELECT *, CAST(period[1:4] AS INTEGER) - CASE WHEN CAST(period[6:7] AS INTEGER) < 4 THEN 1 ELSE 0 END AS fy, CAST(period[1:4] AS INTEGER) * 12 + CAST(period[6:7] AS INTEGER) AS at_ FROM m),
  y AS (SELECT *, sum(month_mt) OVER (PARTITION BY section, entity_key, fy ORDER BY at_) + CASE WHEN at_ % 17 = 0 THEN 100 ELSE 0 END AS ytd_mt FROM fy)"""


@query("publisher_chain_gaps", f"""WITH {_CHAIN}, q AS (SELECT *, lag(at_) OVER w AS at1, lag(ytd_mt) OVER w AS ytd1 FROM y WINDOW w AS (PARTITION BY section, entity_key, fy ORDER BY at_)),
  due AS (SELECT *, CASE WHEN period[6:7] = '04' THEN month_mt WHEN at1 = at_ - 1 THEN ytd1 + month_mt END AS due_mt FROM q) SELECT section, entity_key, period, month_mt, ytd_mt, due_mt FROM due WHERE abs(ytd_mt - due_mt) > greatest(1.0, 0.005 * abs(due_mt))""")
def publisher_chain_gaps(spark, d):
    """[W-26] On figures in which some months are misprinted."""
    m = proxy.facts(spark, d).where("grain = 'AIRPORT'").groupBy(F.col("direction").alias("section"), F.col("airport_iata").alias("entity_key"), "period").agg((F.sum("tonnage_kg") / 1000).alias("month_mt"))
    at = periods.year(F.col("period")) * 12 + periods.month(F.col("period"))
    m = m.withColumns({"_fy": periods.fiscal_start(F.col("period")), "_at": at})
    total = F.sum("month_mt").over(Window.partitionBy("section", "entity_key", "_fy").orderBy("_at"))
    return structure.chain_gaps(m.withColumn("ytd_mt", total + F.when(F.col("_at") % 17 == 0, 100).otherwise(0)).drop("_fy", "_at"))


@query("brief_movers", f"""WITH {proxy.FACT} SELECT airport_iata, sum(tonnage_kg) / 1000 AS tonnage_mt, (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100 AS growth_pct FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2001-07' GROUP BY ALL
  HAVING sum(tonnage_kg) >= 100000 AND sum(prior_year_tonnage_kg) > 0 ORDER BY abs((sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg)) DESC, 1 LIMIT 8""")
def brief_movers(spark, d):
    """[G-8, F-9]"""
    g = proxy.facts(spark, d, "2001-07").where("grain = 'AIRPORT' and direction = 'TOTAL' and period = '2001-07'").groupBy("airport_iata").agg(F.sum("tonnage_kg").alias("t"), F.sum("prior_year_tonnage_kg").alias("p")).where("t >= 100000 and p > 0")
    growth = (F.col("t") - F.col("p")) / F.col("p")
    return g.orderBy(F.abs(growth).desc(), "airport_iata").limit(8).select("airport_iata", (F.col("t") / 1000).alias("tonnage_mt"), (growth * 100).alias("growth_pct"))


@query("collision_detection", f"WITH {proxy.BASE} SELECT airport_iata, period, direction, doc AS source_document_id, count(*) AS rows, count(DISTINCT airline_name) AS names FROM base GROUP BY ALL HAVING count(*) > 1 OR count(DISTINCT airline_name) > 1")
def collision_detection(spark, d):
    """[N-26]"""
    return warehouse.collisions(proxy.base(spark, d).select("airport_iata", "period", "direction", F.col("doc").alias("source_document_id"), F.col("airline_name").alias("airport_name_raw")))


_STORED = f"""{proxy.BASE}, stored AS (SELECT airline_name, period, sum(qty) AS kg, min(doc) AS doc FROM base WHERE period < '2000-01' GROUP BY ALL), new AS (SELECT airline_name, period, sum(qty) * 2 AS kg, max(doc) AS doc FROM base WHERE period >= '1999-06' AND period < '2000-06' GROUP BY ALL)"""


def _stored(spark, d):
    b = proxy.base(spark, d)
    old = b.where("period < '2000-01'").groupBy("airline_name", "period").agg(F.sum("qty").alias("kg"), F.min("doc").alias("doc"))
    new = b.where("period >= '1999-06' and period < '2000-06'").groupBy("airline_name", "period").agg((F.sum("qty") * 2).alias("kg"), F.max("doc").alias("doc"))
    return old, new


@query("latest_wins_upsert", f"WITH {_STORED} SELECT coalesce(s.airline_name, n.airline_name) AS airline_name, coalesce(s.period, n.period) AS period, coalesce(n.kg, s.kg) AS kg, coalesce(s.doc, n.doc) AS doc FROM stored s FULL JOIN new n ON s.airline_name = n.airline_name AND s.period = n.period")
def latest_wins_upsert(spark, d):
    """[S-23, P-1, P-2] Only ``kg`` is refreshed on conflict."""
    return warehouse.upsert(*_stored(spark, d), ["airline_name", "period"], ["kg"])


@query("retire_superseded", f"WITH {_STORED} SELECT 'kept' AS fate, count(*) AS rows, sum(kg) AS kg FROM stored WHERE (airline_name, period) IN (SELECT (airline_name, period) FROM new) UNION ALL SELECT 'retired', count(*), sum(kg) FROM stored WHERE (airline_name, period) NOT IN (SELECT (airline_name, period) FROM new)")
def retire_superseded(spark, d):
    """[S-24, J-14, U-3]"""
    kept, gone = warehouse.retire(*_stored(spark, d), ["airline_name", "period"])
    return kept.select(F.lit("kept").alias("fate"), "kg").unionByName(gone.select(F.lit("retired").alias("fate"), "kg")).groupBy("fate").agg(F.count("*").alias("rows"), F.sum("kg").alias("kg"))


@query("unexplained_antijoin", f"WITH {_STAT} SELECT grain, entity_key, direction, measure, period, severity FROM stat s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT c_nationkey, strftime(o_orderdate, '%Y-%m') AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) e WHERE 'N' || lpad(CAST(e.c_nationkey AS VARCHAR), 2, '0') = s.entity_key AND e.p = s.period)")
def unexplained_antijoin(spark, d):
    """[J-12, J-13] Anomalies that no explanation names."""
    s = series.statistical(series.build(proxy.series_facts(spark, d)))
    o = proxy.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").join(proxy.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = o.select(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("entity_key"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return s.join(told, ["entity_key", "period"], "left_anti").select(*series.KEYS, "period", "severity")


@query("seasonal_components")
def seasonal_components(spark, d):
    """[W-13] Tested by properties."""
    s = series.build(proxy.series_facts(spark, d), 60)
    return kernels.decomposed(s).select(*series.KEYS, "period", *[F.round(c, 3).alias(c) for c in ("trend_kg", "seasonal_kg", "residual_kg")])


@query("merged_anomalies")
def merged_anomalies(spark, d):
    """[W-14, W-16] Tested by properties."""
    return kernels.detect(proxy.kept(series.build(proxy.series_facts(spark, d))))


@query("arima_forecasts")
def arima_forecasts(spark, d):
    """[W-19] Tested by properties."""
    return kernels.arima_forecasts(proxy.kept(series.build(proxy.series_facts(spark, d))))


@query("forecast_five_candidates")
def forecast_five_candidates(spark, d):
    """[W-21] ARIMA among the candidates; tested against the two parts."""
    return kernels.published(proxy.kept(series.build(proxy.series_facts(spark, d))))
