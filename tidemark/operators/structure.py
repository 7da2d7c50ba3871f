"""Market structure: concentration, attribution, decomposition, efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods


def ratio(a: Column, b: Column, digits: int, factor: float = 1.0) -> Column:
    return F.round(F.try_divide(a * factor, b), digits)


def concentration(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """[A-16] Herfindahl index, effective number and top share of each group;
    only positive values count."""
    w = Window.partitionBy(*by)
    shares = values.where(F.col(value) > 0).withColumn("_share", 100 * F.col(value) / F.sum(value).over(w))
    out = shares.groupBy(*by).agg(F.sum(F.col("_share") * F.col("_share")).alias("_hhi"), F.max("_share").alias("_top"), F.count("*").alias("entities"))
    note = F.when(F.col("_hhi") < 1500, "unconcentrated").when(F.col("_hhi") < 2500, "moderately concentrated").otherwise("highly concentrated")
    return out.select(*by, "entities", F.round("_hhi").cast("long").alias("hhi"), F.round(10000 / F.col("_hhi"), 1).alias("effective_n"), F.round("_top", 1).alias("top_share_pct"), note.alias("interpretation"))


def attribution(now: DataFrame, then: DataFrame, top: int = 12) -> DataFrame:
    """[A-19, J-17, L-7] Each entity's part of the change between two frames
    (entity_key, mt): points of the national base and share of the gross change.
    Shares are taken over all, then the top is kept."""
    joined = now.withColumnRenamed("mt", "now_mt").join(then.withColumnRenamed("mt", "then_mt"), "entity_key", "full_outer").na.fill(0.0, ["now_mt", "then_mt"])
    change = joined.withColumn("change_mt", F.col("now_mt") - F.col("then_mt"))
    base = change.agg(F.sum("then_mt").alias("_base"), F.sum(F.abs("change_mt")).alias("_gross"))
    c = change.join(F.broadcast(base)).where("_base > 0 and change_mt <> 0")  # one row
    out = c.select("entity_key", "now_mt", "then_mt", "change_mt", (100 * F.col("change_mt") / F.col("_base")).alias("contribution_pp"), (100 * F.abs("change_mt") / F.col("_gross")).alias("share_of_change_pct"))
    return out.orderBy(F.abs("change_mt").desc(), "entity_key").limit(top)


def pearson(x: Column, y: Column) -> Column:
    """[A-17] Over at least four pairs that vary; else null."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= 4, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def carrier_efficiency(metrics: DataFrame) -> DataFrame:
    """[A-4, A-5] Long metrics to columns, with ratios. Explicit columns: one
    aggregation, no scan for the pivot's values."""
    names = ("ftk_million", "atk_million", "freight_tonnes", "mail_tonnes", "cargo_total_tonnes", "departures", "pax_carried", "pax_load_factor", "block_hours")
    wide = metrics.groupBy("grain", "entity_key", "period", "sort_key", "direction").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    c = F.col
    return wide.withColumns({
        "cargo_load_factor_pct": ratio(c("ftk_million"), c("atk_million"), 2, 100.0),
        "tonnes_per_departure": ratio(c("freight_tonnes"), c("departures"), 3),
        "mail_share_pct": ratio(c("mail_tonnes"), c("cargo_total_tonnes"), 2, 100.0),
        "kg_freight_per_pax": F.round(F.try_divide(c("freight_tonnes"), c("pax_carried")) * 1000, 3),
    })


def airport_efficiency(facts: DataFrame, metrics: DataFrame, airports: DataFrame) -> DataFrame:
    """[A-6, J-10] Freight, flights and passengers of an airport and month."""
    freight = facts.where("grain = 'AIRPORT' and airport_iata is not null").groupBy(F.col("airport_iata").alias("entity_key"), "period", "sort_key", "direction").agg((F.sum("tonnage_kg") / 1000).alias("mt"))
    ops = metrics.where("grain = 'AIRPORT'").groupBy("entity_key", "period", "direction").agg(F.max(F.when(F.col("metric") == "pax_carried", F.col("value"))).alias("pax"), F.max(F.when(F.col("metric") == "aircraft_movements", F.col("value"))).alias("movements"))
    c = F.col
    return freight.join(ops, ["entity_key", "period", "direction"]).join(airports, "entity_key", "left").select(c("entity_key").alias("airport_iata"), "airport_name", "period", "sort_key", "direction", F.round("mt", 1).alias("freight_mt"), "movements", "pax", ratio(c("mt"), c("movements"), 3).alias("tonnes_per_flight"), ratio(c("mt"), c("pax"), 2, 1000.0).alias("kg_per_pax"), ratio(c("pax"), c("movements"), 1).alias("pax_per_flight"))


def growth_decomposition(efficiency: DataFrame) -> DataFrame:
    """[A-20, J-16] The latest month against the same a year before: what more
    flights alone would have brought, and the rest. For every airport and
    direction of 13 months or more at once, on the rounded columns."""
    e = efficiency.where("tonnes_per_flight is not null")
    w = Window.partitionBy("airport_iata", "direction")
    e = e.withColumns({"_n": F.count("*").over(w), "_last": F.max("sort_key").over(w)})
    now = e.where("_n >= 13 and sort_key = _last").select("airport_iata", "direction", F.col("period").alias("period_now"), periods.prior_label(F.col("period")).alias("period_then"), F.col("freight_mt").alias("f1"), F.col("movements").alias("m1"))
    then = e.select("airport_iata", "direction", F.col("period").alias("period_then"), F.col("freight_mt").alias("f0"), F.col("movements").alias("m0"), F.col("tonnes_per_flight").alias("t0"))
    j = now.join(then, ["airport_iata", "direction", "period_then"])
    flights = (F.col("m1") - F.col("m0")) * F.col("t0")
    rest = F.col("f1") - F.col("f0") - flights
    return j.select("airport_iata", "direction", "period_now", "period_then", F.round(F.col("f1") - F.col("f0"), 1).alias("change_mt"), ratio(F.col("f1") - F.col("f0"), F.col("f0"), 2, 100.0).alias("change_pct"), F.round(flights, 1).alias("more_flights_mt"), F.round(rest, 1).alias("fuller_flights_mt"), F.when(F.abs(flights) > F.abs(rest), "more flights").otherwise("fuller flights").alias("driver"))


def belly_dependency(efficiency: DataFrame) -> DataFrame:
    """[A-17, A-18] Whether a carrier's freight rides with its passengers."""
    e = efficiency.where("direction = 'TOTAL' and freight_tonnes is not null")
    carried = F.col("pax_carried") > 0
    g = e.groupBy("entity_key").agg(F.count("*").alias("months"), F.max(F.coalesce(carried, F.lit(False))).alias("flies_pax"), pearson(F.when(carried, F.col("freight_tonnes")), F.when(carried, F.col("pax_carried"))).alias("r"), F.round(F.avg("cargo_load_factor_pct"), 1).alias("mean_load_factor_pct"), F.round(F.avg("tonnes_per_departure"), 2).alias("mean_tonnes_per_departure"))
    kind = F.when(~F.col("flies_pax"), "freighter").when(F.col("mean_tonnes_per_departure") >= 5, "freighter").otherwise("belly")
    return g.select("entity_key", "months", kind.alias("kind"), F.round("r", 3).alias("correlation"), "mean_load_factor_pct", "mean_tonnes_per_departure")


def component_identity(facts: DataFrame) -> DataFrame:
    """[A-21] International plus domestic against the published total."""
    kg = lambda d: F.sum(F.when(F.col("direction") == d, F.col("tonnage_kg")))
    g = facts.where("grain = 'AIRPORT'").groupBy("airport_iata", "period").agg(kg("INTERNATIONAL").alias("intl"), kg("DOMESTIC").alias("dom"), kg("TOTAL").alias("total")).where("intl is not null and dom is not null and total is not null")
    off = F.abs(F.col("intl") + F.col("dom") - F.col("total"))
    return g.select("airport_iata", "period", (off <= F.greatest(F.lit(1.0), 0.001 * F.col("total"))).alias("holds"), (off > 0.05 * F.col("total")).alias("broken"), off.alias("mismatch_kg"))


def chain_gaps(rows: DataFrame) -> DataFrame:
    """[W-26] Cumulative figures that don't continue the month before in the same
    fiscal year. ``rows``: section, entity_key, period, month_mt, ytd_mt."""
    fy = periods.fiscal_start(F.col("period"))
    at = periods.year(F.col("period")) * 12 + periods.month(F.col("period"))
    w = Window.partitionBy("section", "entity_key", "fy").orderBy("at")
    r = rows.withColumns({"fy": fy, "at": at}).withColumns({"_at": F.lag("at").over(w), "_ytd": F.lag("ytd_mt").over(w)})
    first = periods.month(F.col("period")) == 4
    due = F.when(first, F.col("month_mt")).when(F.col("_at") == F.col("at") - 1, F.col("_ytd") + F.col("month_mt"))
    return r.withColumn("due_mt", due).where(due.isNotNull() & (F.abs(F.col("ytd_mt") - due) > F.greatest(F.lit(1.0), 0.005 * F.abs(due)))).select("section", "entity_key", "period", "month_mt", "ytd_mt", "due_mt")
