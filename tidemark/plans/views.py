"""Registered queries: reading views with names, labels and their review,
evidence and insights, answers to questions, and roll-ups of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells, periods
from tidemark.operators import retrieval, series, traces
from tidemark.plans import analytics, material, proxy
from tidemark.plans.registry import query
from tidemark.plans.semantic import QuerySpec, compile_query

_NAMES = """ap AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS k, any_value(n_name) AS airport_name FROM nation GROUP BY 1),
  al AS (SELECT DISTINCT 'C' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') AS airline_name FROM supplier)"""


def named(rows: DataFrame, spark, d) -> DataFrame:
    """Rows with the names of their entity. Dimensions have one row for each key,
    so a code that repeats there doesn't repeat rows here."""
    ap = proxy.airports(spark, d).groupBy("entity_key").agg(F.min("airport_name").alias("airport_name"))
    al = proxy.table(spark, d, "supplier").select(F.concat(F.lit("C"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0")).alias("entity_key")).distinct().withColumn("airline_name", F.col("entity_key"))
    return rows.join(ap, "entity_key", "left").join(al, "entity_key", "left")


def _periods(spark, d) -> DataFrame:
    """The period dimension: the months of the orders."""
    p = F.date_format("o_orderdate", "yyyy-MM")
    return proxy.table(spark, d, "orders").select(p.alias("period")).distinct().withColumn("sort_key", periods.sort_key(F.col("period")))


_PERIODS = "dp AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders)"


@query("trend_view", f"""WITH {analytics._TREND}, {_NAMES}, {_PERIODS} SELECT grain, entity_key, t.direction, measure, period, sort_key, tonnage_kg, round((tonnage_kg - v1) / nullif(v1, 0) * 100, 2) AS mom_pct, ap.airport_name, al.airline_name
  FROM t JOIN dp USING (period) LEFT JOIN ap ON ap.k = entity_key LEFT JOIN al ON al.airline_name = entity_key""")
def trend_view(spark, d):
    """[J-2]"""
    facts = proxy.kept(proxy.series_facts(spark, d))
    t = series.trend(series.build(facts), series.national_totals(facts)).join(_periods(spark, d).select("period"), "period")
    return named(t, spark, d).select(*series.KEYS, "period", "sort_key", "tonnage_kg", "mom_pct", "airport_name", "airline_name")


@query("anomaly_view", f"""WITH {analytics._STAT}, {_NAMES}, {_PERIODS} SELECT grain, entity_key, direction, measure, period, observed_kg, expected_kg, deviation_pct, severity, ap.airport_name, al.airline_name
  FROM stat JOIN dp USING (period) LEFT JOIN ap ON ap.k = entity_key LEFT JOIN al ON al.airline_name = entity_key""")
def anomaly_view(spark, d):
    """[J-3]"""
    a = series.statistical(series.build(proxy.series_facts(spark, d))).join(_periods(spark, d).select("period"), "period")
    return named(a, spark, d).select(*series.KEYS, "period", "observed_kg", "expected_kg", "deviation_pct", "severity", "airport_name", "airline_name")


@query("forecast_view", f"""WITH {analytics._TEST}, {_NAMES}, last_ AS (SELECT * FROM cd WHERE i = n AND n >= 8)
  SELECT grain, entity_key, direction, measure, strftime(CAST(period || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS period, b.model, b.mape AS backtest_mape, ap.airport_name, al.airline_name
  FROM last_ JOIN best b USING (grain, entity_key, direction, measure) LEFT JOIN ap ON ap.k = entity_key LEFT JOIN al ON al.airline_name = entity_key""")
def forecast_view(spark, d):
    """[J-4] Labels lie ahead, so periods aren't joined."""
    f = series.forecasts(proxy.kept(series.build(proxy.series_facts(spark, d))), horizon=1)
    return named(f, spark, d).select(*series.KEYS, "period", "model", "backtest_mape", "airport_name", "airline_name")


def headline(a: DataFrame) -> DataFrame:
    """[G-6] The plain sentence of an anomaly, made of its own figures."""
    tonnes = lambda c: F.format_string("%.1f", F.col(c) / 1000)
    way = F.when(F.col("observed_kg") >= F.col("expected_kg"), "above").otherwise("below")
    return a.withColumns({
        "headline": F.concat_ws(" ", "entity_key", "period", way, F.lit("expectation")),
        "narrative": F.concat_ws(" ", "entity_key", F.lit("moved"), tonnes("observed_kg"), F.lit("MT in"), "period", F.lit("against an expected"), tonnes("expected_kg"), F.lit("MT.")),
    })


@query("insight_view", f"""WITH {analytics._STAT}, a AS (SELECT *, row_number() OVER (ORDER BY abs(deviation_pct) DESC NULLS LAST, grain, entity_key, direction, measure, period) AS r FROM stat),
  i AS (SELECT r AS insight_id, CASE WHEN r % 4 <> 0 THEN r END AS anomaly_id, entity_key || ' ' || period || CASE WHEN observed_kg >= expected_kg THEN ' above' ELSE ' below' END || ' expectation' AS headline, entity_key || ' moved ' || printf('%.1f', observed_kg / 1000) || ' MT in ' || period || ' against an expected ' || printf('%.1f', expected_kg / 1000) || ' MT.' AS narrative FROM a WHERE r <= 25)
  SELECT insight_id, headline, narrative, a.entity_key, a.severity, a.period, a.observed_kg FROM i LEFT JOIN a ON a.r = i.anomaly_id LEFT JOIN (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders) p ON p.period = a.period""")
def insight_view(spark, d):
    """[J-6, G-6, P-10] Narratives of the 25 strongest anomalies, with the
    anomaly where it still stands; each passes the grounding check."""
    s = series.statistical(series.build(proxy.series_facts(spark, d)))
    order = [F.abs("deviation_pct").desc_nulls_last(), *series.KEYS, "period"]
    a = proxy.kept(s.orderBy(*order).limit(25))
    a = a.withColumn("anomaly_id", F.row_number().over(Window.orderBy(*order)))  # 25 rows
    told = headline(a)
    fine = cells.grounded(F.regexp_replace("narrative", F.col("entity_key"), F.lit("")), F.array(F.col("observed_kg") / 1000, F.col("expected_kg") / 1000), F.lit(1))
    i = told.where(fine).select(F.col("anomaly_id").alias("insight_id"), F.when(F.col("anomaly_id") % 4 != 0, F.col("anomaly_id")).alias("anomaly_id"), "headline", "narrative")
    full = i.join(a, "anomaly_id", "left").join(_periods(spark, d).select("period"), "period", "left")
    return full.select("insight_id", "headline", "narrative", "entity_key", "severity", "period", "observed_kg")


def _chunks(spark, d) -> DataFrame:
    return retrieval.chunks(proxy.table(spark, d, "documents").select("doc_id", "text"))


@query("chunk_view")
def chunk_view(spark, d):
    """[J-8, R-5] Passages with their document's particulars; tested by brute force."""
    docs = proxy.table(spark, d, "documents").select("doc_id", F.col("source").alias("publisher"), "lang")
    return _chunks(spark, d).join(docs, "doc_id").select("doc_id", "seq", "publisher", "lang", "token_estimate", F.md5("content").alias("content_md5"))


@query("index_stats")
def index_stats(spark, d):
    """[A-13, R-16] Passages, documents and tokens of each publisher."""
    docs = proxy.table(spark, d, "documents").select("doc_id", F.col("source").alias("publisher"))
    return _chunks(spark, d).join(docs, "doc_id").groupBy("publisher").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("token_estimate").alias("tokens"))


@query("chunk_lookup", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunk_lookup(spark, d):
    """[J-20] Rows of a list of ids."""
    ids = proxy.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    return proxy.table(spark, d, "embeddings").select("vec_id", "label").join(ids, "vec_id", "left_semi")


# ---- labels: routes stand for entities; some published totals are misprinted

_LABELS = f"""{proxy.SPARSE}, parts AS (SELECT *, q * CASE WHEN period LIKE '%-07' THEN 1.2 ELSE 1.0 END AS t FROM (SELECT airline_name || '-' || airport_iata AS entity_key, period, sum(qty) FILTER (direction = 'INTERNATIONAL') AS i, sum(qty) FILTER (direction = 'DOMESTIC') AS dm, sum(qty) AS q FROM base GROUP BY ALL)),
  broken AS (SELECT entity_key, period FROM parts WHERE i IS NOT NULL AND dm IS NOT NULL AND t > 0 AND abs(i + dm - t) / t > 0.05),
  w AS (SELECT *, list(tonnage_kg) OVER (PARTITION BY entity_key ORDER BY sort_key ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, list(tonnage_kg) OVER (PARTITION BY entity_key ORDER BY sort_key ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM sparse),
  moves AS (SELECT *, tonnage_kg > 0 AND list_max(b) = 0 AND list_min(a) > 0 AS started, tonnage_kg > 0 AND list_min(b) > 0 AND list_max(a) = 0 AS stopped FROM w WHERE len(a) = 3 AND len(b) = 3),
  lab AS (SELECT entity_key, period, CASE WHEN started OR stopped THEN 'GENUINE' ELSE 'SPURIOUS' END AS label, CASE WHEN started THEN 'service_started' WHEN stopped THEN 'service_stopped' ELSE 'parts do not sum' END AS basis FROM moves
    WHERE (started OR stopped OR (entity_key, period) IN (SELECT (entity_key, period) FROM broken)) AND NOT (entity_key LIKE 'C01-%' AND period LIKE '1996-%'))"""


def _sparse(spark, d) -> DataFrame:
    return proxy.kept(proxy.sparse(spark, d))


def _labels(spark, d, routes: DataFrame) -> DataFrame:
    b = proxy.base(spark, d).withColumn("entity_key", F.concat_ws("-", "airline_name", "airport_iata"))
    part = lambda x: F.sum(F.when(F.col("direction") == x, F.col("qty")))
    parts = b.groupBy("entity_key", "period").agg(part("INTERNATIONAL").alias("i"), part("DOMESTIC").alias("dm"), F.sum("qty").alias("q")).withColumn("t", F.col("q") * F.when(F.col("period").endswith("-07"), 1.2).otherwise(1.0))
    broken = parts.where("i is not null and dm is not null and t > 0 and abs(i + dm - t) / t > 0.05")
    human = routes.where("entity_key like 'C01-%' and period like '1996-%'").select("grain", "entity_key", "direction", "period")
    return series.rule_labels(routes, broken, human)


@query("rule_labels", f"WITH {_LABELS} SELECT * FROM lab")
def rule_labels(spark, d):
    """[W-25]"""
    return _labels(spark, d, _sparse(spark, d)).select("entity_key", "period", "label", "basis")


_ALERTS = """al0 AS (SELECT entity_key, period, tonnage_kg AS observed_kg FROM moves WHERE started OR stopped UNION ALL SELECT entity_key, period, tonnage_kg FROM sparse WHERE tonnage_kg >= 150000)"""


def _alerts(routes: DataFrame) -> DataFrame:
    """Alerts on routes: services that start or stop, and very large months."""
    large = routes.where("tonnage_kg >= 150000").select(*series.KEYS, "period", F.col("tonnage_kg").alias("observed_kg"))
    return series.structural(routes).select(*series.KEYS, "period", "observed_kg").unionByName(large)


@query("review_queue", f"WITH {_LABELS}, {_ALERTS} SELECT entity_key, period, observed_kg FROM al0 WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.entity_key = al0.entity_key AND lab.period = al0.period) ORDER BY observed_kg DESC, entity_key, period LIMIT 40")
def review_queue(spark, d):
    """[G-13, J-13]"""
    routes = _sparse(spark, d)
    return series.pending(_alerts(routes), _labels(spark, d, routes)).select("entity_key", "period", "observed_kg")


@query("detector_against_labels", f"""WITH {_LABELS}, {_ALERTS}, j AS (SELECT label = 'GENUINE' AS g, s.tonnage_kg >= 50000 AS m, (lab.entity_key, lab.period) IN (SELECT (entity_key, period) FROM al0) AS h FROM lab JOIN sparse s ON s.entity_key = lab.entity_key AND s.period = lab.period)
  SELECT count(*) FILTER (g AND h) AS tp, count(*) FILTER (NOT g AND h) AS fp, count(*) FILTER (g AND NOT h) AS fn, round(count(*) FILTER (g AND h) / nullif(count(*) FILTER (h), 0), 6) AS precision_, round(count(*) FILTER (g AND h) / nullif(count(*) FILTER (g), 0), 6) AS recall_, round(count(*) FILTER (g AND m AND h) / nullif(count(*) FILTER (g AND m), 0), 6) AS recall_material FROM j""")
def detector_against_labels(spark, d):
    """[A-15, A-24, J-18, P-16]"""
    routes = _sparse(spark, d)
    labels = _labels(spark, d, routes).join(routes.select("entity_key", "period", "tonnage_kg"), ["entity_key", "period"])
    return series.judged(labels, _alerts(routes), F.col("tonnage_kg") >= 50_000)


@query("anomaly_evidence", f"""WITH {analytics._STAT}, a AS (SELECT *, row_number() OVER (ORDER BY abs(deviation_pct) DESC NULLS LAST, grain, entity_key, direction, measure, period) AS r FROM stat), few AS (SELECT * FROM a WHERE r <= 25),
  s AS (SELECT few.r, count(*) AS points, round(sum(round(series.tonnage_kg / 1000, 1)), 1) AS total_mt FROM few JOIN series USING (grain, entity_key, direction) GROUP BY 1),
  f AS (SELECT r, list(source_document_id ORDER BY source_document_id)[1:5] AS docs FROM (SELECT DISTINCT few.r, fact.source_document_id FROM few JOIN fact ON few.grain = fact.grain AND few.period = fact.period AND (fact.airport_iata = few.entity_key OR fact.airline_name = few.entity_key)) GROUP BY 1)
  SELECT few.grain, few.entity_key, few.direction, few.measure, few.period, points, total_mt, array_to_string(docs, ',') AS sources FROM few JOIN s USING (r) JOIN f USING (r)""")
def anomaly_evidence(spark, d):
    """[G-7] Beside each anomaly its series and up to five documents: two joins
    for all, not a query for each."""
    facts = proxy.kept(proxy.facts(spark, d))
    built = series.build(facts.where("period < '2001-08'"))
    few = proxy.kept(series.statistical(built).orderBy(F.abs("deviation_pct").desc_nulls_last(), *series.KEYS, "period").limit(25).select(*series.KEYS, "period"))
    key = [*series.KEYS, "period"]
    line = built.select("grain", "entity_key", "direction", F.col("sort_key").alias("_s"), F.round(F.col("tonnage_kg") / 1000, 1).alias("_mt"))
    told = few.join(line, ["grain", "entity_key", "direction"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_s", "_mt"))).alias("series"))
    own = facts.select("grain", F.coalesce("airport_iata", "airline_name").alias("entity_key"), "period", F.col("source_document_id").alias("_doc")).distinct()
    docs = few.join(own, ["grain", "entity_key", "period"]).groupBy(*key).agg(F.slice(F.sort_array(F.collect_set("_doc")), 1, 5).alias("docs"))
    total = F.aggregate("series", F.lit(0.0), lambda s, x: s + x["_mt"])
    return told.join(docs, key).select(*key, F.size("series").cast("long").alias("points"), F.round(total, 1).alias("total_mt"), F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("sources"))


# ---- answers to the six kinds of question


def ranked_airports(facts: DataFrame, direction: str, period: str, by_growth: bool) -> DataFrame:
    """[G-3, L-8] Five airports by tonnage or growth; those without a growth are
    dropped after the five are taken."""
    order = "growth_yoy_pct" if by_growth else "tonnage_mt"
    filters = {"grain": "AIRPORT", "direction": direction, "period": period} | ({"min_tonnage_kg": 100_000.0} if by_growth else {})
    top = compile_query(QuerySpec(["tonnage_mt", "growth_yoy_pct"], ["airport_iata", "airport_name"], filters, order, True, 5), facts)
    return top.where(F.col(order).isNotNull())


@query("answer_airport_ranking", f"WITH {proxy.FACT} SELECT * FROM (SELECT airport_iata, airport_name, sum(tonnage_kg) / 1000.0 AS tonnage_mt, CASE WHEN sum(prior_year_tonnage_kg) > 0 THEN (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100.0 END AS growth_yoy_pct FROM fact WHERE grain = 'AIRPORT' AND direction = 'INTERNATIONAL' AND period = '1995-07' GROUP BY ALL ORDER BY tonnage_mt DESC, 1, 2 LIMIT 5)")
def answer_airport_ranking(spark, d):
    """[G-3] Airports of a month by tonnage."""
    return ranked_airports(proxy.facts(spark, d, "1995-07"), "INTERNATIONAL", "1995-07", False)


@query("answer_airport_growth", f"WITH {proxy.FACT} SELECT * FROM (SELECT airport_iata, airport_name, sum(tonnage_kg) / 1000.0 AS tonnage_mt, CASE WHEN sum(prior_year_tonnage_kg) > 0 THEN (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100.0 END AS growth_yoy_pct FROM fact WHERE grain = 'AIRPORT' AND direction = 'TOTAL' AND period = '2000-03' AND tonnage_kg >= 100000 GROUP BY ALL ORDER BY growth_yoy_pct DESC NULLS LAST, 1, 2 LIMIT 5) WHERE growth_yoy_pct IS NOT NULL")
def answer_airport_growth(spark, d):
    """[G-3, L-8, F-8] Airports of a month by growth."""
    return ranked_airports(proxy.facts(spark, d, "2000-03"), "TOTAL", "2000-03", True)


@query("answer_airline_ranking", f"WITH {proxy.FACT} SELECT airline_name, sum(tonnage_kg) / 1000.0 AS tonnage_mt FROM fact WHERE grain = 'AIRLINE' AND direction = 'TOTAL' AND (is_aggregate IS NULL OR NOT is_aggregate) GROUP BY ALL ORDER BY tonnage_mt DESC, 1 LIMIT 5")
def answer_airline_ranking(spark, d):
    """[G-3] Carriers over all periods, without industry totals."""
    return compile_query(QuerySpec(["tonnage_mt"], ["airline_name"], {"grain": "AIRLINE", "direction": "TOTAL", "exclude_aggregate_airlines": True}, "tonnage_mt", True, 5), proxy.facts(spark, d))


@query("answer_anomalies", f"WITH {analytics._STAT}, {_NAMES} SELECT entity_key, coalesce(ap.airport_name, al.airline_name) AS entity_name, direction, period, round(observed_kg / 1000, 1) AS observed_mt, round(expected_kg / 1000, 1) AS expected_mt, round(deviation_pct, 1) AS deviation_pct, severity FROM stat LEFT JOIN ap ON ap.k = entity_key LEFT JOIN al ON al.airline_name = entity_key ORDER BY abs(stat.deviation_pct) DESC NULLS LAST, entity_key, direction, measure, period LIMIT 5")
def answer_anomalies(spark, d):
    """[G-3] The most deviant anomalies."""
    a = series.statistical(series.build(proxy.series_facts(spark, d)))
    top = a.orderBy(F.abs("deviation_pct").desc_nulls_last(), "entity_key", "direction", "measure", "period").limit(5)
    mt = lambda c: F.round(F.col(c) / 1000, 1)
    return named(top, spark, d).select("entity_key", F.coalesce("airport_name", "airline_name").alias("entity_name"), "direction", "period", mt("observed_kg").alias("observed_mt"), mt("expected_kg").alias("expected_mt"), F.round("deviation_pct", 1).alias("deviation_pct"), "severity")


@query("answer_forecasts", f"""WITH {analytics._TEST}, last_ AS (SELECT *, list(tonnage_kg) OVER (PARTITION BY grain, entity_key, direction, measure ORDER BY sort_key ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS ss FROM cd),
  p AS (SELECT l.grain, l.entity_key, l.direction, l.measure, b.model, b.mape, CASE b.model WHEN 'naive' THEN naive WHEN 'drift' THEN tonnage_kg + slope WHEN 'recent_mean' THEN recent_mean ELSE CASE WHEN len(ss) = 12 THEN ss[1] ELSE naive END END AS pt FROM last_ l JOIN best b USING (grain, entity_key, direction, measure) WHERE i = n AND n >= 8)
  SELECT entity_key, direction, round(round(greatest(0.0, pt), 3) / 1000, 1) AS predicted_mt, model, round(mape, 1) AS backtest_mape_pct FROM p ORDER BY round(greatest(0.0, pt), 3) DESC, entity_key, direction, measure LIMIT 5""")
def answer_forecasts(spark, d):
    """[G-3] The largest figures of the next month."""
    f = series.forecasts(proxy.kept(series.build(proxy.series_facts(spark, d))), horizon=1)
    top = f.orderBy(F.desc("predicted_kg"), "entity_key", "direction", "measure").limit(5)
    return top.select("entity_key", "direction", F.round(F.col("predicted_kg") / 1000, 1).alias("predicted_mt"), "model", F.round("backtest_mape", 1).alias("backtest_mape_pct"))


@query("answer_airport_trend", f"WITH {proxy.FACT} SELECT period, airport_iata, sum(tonnage_kg) / 1000.0 AS tonnage_mt, CASE WHEN sum(prior_year_tonnage_kg) > 0 THEN (sum(tonnage_kg) - sum(prior_year_tonnage_kg)) / sum(prior_year_tonnage_kg) * 100.0 END AS growth_yoy_pct FROM fact WHERE grain = 'AIRPORT' AND direction = 'DOMESTIC' AND airport_iata = 'N07' GROUP BY ALL ORDER BY period, airport_iata LIMIT 200")
def answer_airport_trend(spark, d):
    """[G-2, G-3] The airport that the question names, if the data have it."""
    known = proxy.airports(spark, d).select("entity_key")
    code = traces.asked_code("How has N07 changed over time?", known)
    return compile_query(QuerySpec(["tonnage_mt", "growth_yoy_pct"], ["period", "airport_iata"], {"grain": "AIRPORT", "direction": "DOMESTIC", "airport_iata": code}, "period", False, 200), proxy.facts(spark, d))


@query("answer_sources", f"""WITH {proxy.FACT}, doc AS (SELECT o_orderkey AS source_document_id, o_orderpriority AS publisher FROM orders)
  SELECT publisher, count(*) AS documents, sum(n) AS facts FROM (SELECT doc.publisher, doc.source_document_id, count(fact.grain) AS n FROM doc LEFT JOIN fact USING (source_document_id) GROUP BY ALL) GROUP BY publisher ORDER BY facts DESC""")
def answer_sources(spark, d):
    """[G-3] Publishers by facts."""
    return analytics.source_fact_counts(spark, d).orderBy(F.desc_nulls_last("facts"))


# ---- roll-ups of runs

_RUN = f"""{material._TRACE}, run AS (SELECT run_id, count(*) AS steps, bool_and(ok) AS succeeded, sum(elapsed_ms) AS ms, min_by(tool, seq) AS agent, CASE WHEN count(*) FILTER (policy = 'model') = 0 THEN 'heuristic' WHEN count(*) FILTER (policy LIKE 'heuristic (%') > 0 THEN 'mixed' ELSE 'model' END AS effective_policy, sum(elapsed_ms % 5) AS tokens FROM step GROUP BY run_id)"""


def _runs(spark, d) -> DataFrame:
    steps = material._steps(spark, d).withColumn("tokens", F.col("elapsed_ms") % 5)
    return traces.runs(steps)


@query("agent_rollup", f"WITH {_RUN} SELECT agent, count(*) AS runs, sum(steps) AS steps, count(*) FILTER (succeeded) AS succeeded, round(avg(steps), 2) AS avg_steps, round(avg(ms), 0) AS avg_ms FROM run GROUP BY agent")
def agent_rollup(spark, d):
    """[A-10, J-7]"""
    return _runs(spark, d).groupBy("agent").agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.count_if("succeeded").alias("succeeded"), F.round(F.avg("steps"), 2).alias("avg_steps"), F.round(F.avg("ms"), 0).alias("avg_ms"))


@query("policy_rollup", f"WITH {_RUN} SELECT effective_policy, count(*) AS runs, sum(steps) AS steps, count(*) FILTER (succeeded) AS succeeded FROM run GROUP BY ALL")
def policy_rollup(spark, d):
    """[A-10]"""
    return _runs(spark, d).groupBy("effective_policy").agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.count_if("succeeded").alias("succeeded"))


@query("run_totals", f"WITH {_RUN} SELECT count(*) AS runs, sum(steps) AS steps, sum(tokens) AS tokens, count(*) FILTER (tokens > 0) AS runs_with_usage, count(*) FILTER (succeeded) AS succeeded FROM run")
def run_totals(spark, d):
    """[A-10, P-13]"""
    return _runs(spark, d).agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("runs_with_usage"), F.count_if("succeeded").alias("succeeded"))


@query("step_run_view", f"WITH {_RUN} SELECT s.run_id, seq, tool, s.ok, agent, effective_policy FROM step s JOIN run USING (run_id)")
def step_run_view(spark, d):
    """[J-7] Steps beside their run."""
    steps = material._steps(spark, d)
    return steps.join(_runs(spark, d).select("run_id", "agent", "effective_policy"), "run_id").select("run_id", "seq", "tool", "ok", "agent", "effective_policy")


@query("recent_runs", f"WITH {_RUN} SELECT run_id, agent, steps FROM run ORDER BY run_id DESC LIMIT 20")
def recent_runs(spark, d):
    """[P-14] The newest runs."""
    return _runs(spark, d).orderBy(F.desc("run_id")).limit(20).select("run_id", "agent", "steps")

