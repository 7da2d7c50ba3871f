"""The statistics model over the driver's tables: customers' nations stand for
airports, suppliers for carriers, order months for periods. Each frame has a SQL
twin for the oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.store import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once, for queries that read it more than once."""
    return Scratch(df.sparkSession, "facts").cut(df, "table")


def _month(label: str, years: int = 0) -> Column:
    """The condition that an order is of the month ``label``, ``years`` before:
    a range of dates, which reaches the scan."""
    first = dt.datetime(int(label[:4]) - years, int(label[5:7]), 1)
    later = dt.datetime(first.year + first.month // 12, first.month % 12 + 1, 1)
    return (F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(later).cast("timestamp_ntz"))


def base(spark: SparkSession, d: str, month: str | None = None) -> DataFrame:
    """One row for each line item, on demand of one month and its year before.
    Dimensions are left to the optimizer, which broadcasts them below its size limit."""
    nation = table(spark, d, "nation")
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("airport_name"), F.col("n_regionkey").alias("c_region"))
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("s_region"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if month:
        orders = orders.where(_month(month) | _month(month, 1))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(cn, "c_nationkey")
    supp = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(sn, "s_nationkey")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    code = lambda p, c: F.concat(F.lit(p), F.lpad(c.cast("string"), 2, "0"))
    return j.select(
        code("N", F.col("c_nationkey")).alias("airport_iata"), "airport_name", F.col("c_region").cast("string").alias("country"), code("C", F.col("l_suppkey") % 20).alias("airline_name"),
        F.when(F.col("c_region") == F.col("s_region"), "DOMESTIC").otherwise("INTERNATIONAL").alias("direction"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_orderpriority").alias("publisher"), F.col("l_returnflag").alias("measure"), F.col("o_orderkey").alias("doc"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
    )


BASE = """base AS (
  SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS airport_iata, cn.n_name AS airport_name, CAST(cn.n_regionkey AS VARCHAR) AS country,
    'C' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS airline_name,
    CASE WHEN cn.n_regionkey = sn.n_regionkey THEN 'DOMESTIC' ELSE 'INTERNATIONAL' END AS direction,
    strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS publisher, l_returnflag AS measure, o_orderkey AS doc, l_quantity AS qty, l_discount AS disc, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""

_FACT = ["grain", "airport_iata", "airport_name", "country", "airline_name", "is_aggregate", "period", "direction", "publisher", "measure"]


def _each(*rows: dict[str, Column | str | bool | None]) -> Column:
    """One row of ``rows`` after another: several groupings of one scan."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.explode(F.array(*[F.struct(*[lit(v).alias(k) for k, v in r.items()]) for r in rows])).alias("x")


def facts(spark: SparkSession, d: str, month: str | None = None) -> DataFrame:
    """[J-1, S-23] The fact view: airport facts by direction with a TOTAL, carrier
    facts with an industry row, period attributes, and the figure of a year before.

    One scan and one aggregation of the line items at both grains; totals come
    from its result, and the year before by a window over that. ``month``: only
    that month's facts are whole, and only it and its year before are read."""
    b, none = base(spark, d, month), F.lit(None).cast("string")
    c = F.col
    air = {"grain": "AIRPORT", "airport_iata": c("airport_iata"), "airport_name": c("airport_name"), "country": c("country"), "airline_name": none, "direction": c("direction"), "publisher": c("publisher"), "measure": "freight"}
    car = {"grain": "AIRLINE", "airport_iata": none, "airport_name": none, "country": none, "airline_name": c("airline_name"), "direction": "TOTAL", "publisher": "CARRIERS", "measure": c("measure")}
    keys = [*air, "period"]
    fine = b.select("period", "qty", "doc", _each(air, car)).select("period", "qty", "doc", "x.*").groupBy(*keys).agg(F.sum("qty").alias("q"), F.min("doc").alias("doc"))
    total = F.array(F.struct("airline_name", "direction"), F.struct(F.when(c("grain") == "AIRLINE", "All carriers").alias("airline_name"), F.lit("TOTAL").alias("direction")))
    both = fine.withColumn("x", F.explode(total)).withColumns({"airline_name": c("x.airline_name"), "direction": c("x.direction")}).groupBy(*keys).agg(F.sum("q").alias("q"), F.min("doc").alias("doc"))
    p = c("period")
    all_ = both.select(*keys, (c("airline_name") == "All carriers").alias("is_aggregate"), (c("q") * 1000).alias("tonnage_kg"), c("doc").alias("source_document_id"), periods.kind(p).alias("period_kind"), periods.year(p).alias("calendar_year"), periods.month(p).alias("calendar_month"), periods.sort_key(p).alias("sort_key"))
    series = Window.partitionBy(*[k for k in keys if k != "period"]).orderBy("sort_key").rangeBetween(-100, -100)  # a year before
    g = all_.withColumn("prior_year_tonnage_kg", F.max("tonnage_kg").over(series))
    return g.select(*_FACT, "tonnage_kg", "source_document_id", "prior_year_tonnage_kg", "period_kind", "calendar_year", "calendar_month", "sort_key")


FACT = f"""{BASE}, air AS (
  SELECT airport_iata, airport_name, country, period, publisher, direction, sum(qty) AS q, min(doc) AS doc FROM base GROUP BY ALL
  UNION ALL SELECT airport_iata, airport_name, country, period, publisher, 'TOTAL', sum(qty), min(doc) FROM base GROUP BY ALL),
car AS (
  SELECT airline_name, period, measure, sum(qty) AS q, min(doc) AS doc FROM base GROUP BY ALL
  UNION ALL SELECT 'All carriers', period, measure, sum(qty), min(doc) FROM base GROUP BY ALL),
raw AS (
  SELECT 'AIRPORT' AS grain, airport_iata, airport_name, country, CAST(NULL AS VARCHAR) AS airline_name, CAST(NULL AS BOOLEAN) AS is_aggregate, period, direction, publisher, 'freight' AS measure, q * 1000 AS tonnage_kg, doc AS source_document_id FROM air
  UNION ALL SELECT 'AIRLINE', NULL, NULL, NULL, airline_name, airline_name = 'All carriers', period, 'TOTAL', 'CARRIERS', measure, q * 1000, doc FROM car),
fact AS (
  SELECT a.*, b.tonnage_kg AS prior_year_tonnage_kg, 'MONTH' AS period_kind, CAST(a.period[1:4] AS INTEGER) AS calendar_year, CAST(a.period[6:7] AS INTEGER) AS calendar_month, CAST(a.period[1:4] AS INTEGER) * 100 + CAST(a.period[6:7] AS INTEGER) AS sort_key
  FROM raw a LEFT JOIN raw b ON a.grain = b.grain AND coalesce(a.airport_iata, '-') = coalesce(b.airport_iata, '-') AND coalesce(a.airline_name, '-') = coalesce(b.airline_name, '-') AND a.direction = b.direction AND a.publisher = b.publisher AND a.measure = b.measure
    AND b.period = CAST(CAST(a.period[1:4] AS INTEGER) - 1 AS VARCHAR) || a.period[5:7])"""


def series_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts without the last, partial month."""
    return facts(spark, d).where("period < '2001-08'")


SERIES = f"""{FACT}, series AS (
  SELECT *, count(*) OVER (PARTITION BY grain, entity_key, direction, measure) AS n_points FROM (
    SELECT grain, coalesce(airport_iata, airport_name, airline_name) AS entity_key, direction, measure, period, sort_key, sum(tonnage_kg) AS tonnage_kg, sum(prior_year_tonnage_kg) AS prior_kg
    FROM fact WHERE period < '2001-08' AND (is_aggregate IS NULL OR NOT is_aggregate) GROUP BY ALL))"""


def metrics(spark: SparkSession, d: str, grain: str | None = None) -> DataFrame:
    """[J-9, T7] Operating metrics in long form: carriers in total, airports by
    direction and in total; of one scan, on demand of one grain."""
    c = F.col
    car = {"grain": "AIRLINE", "entity_key": c("airline_name"), "direction": "TOTAL"}
    air = {"grain": "AIRPORT", "entity_key": c("airport_iata"), "direction": c("direction")}
    rows = {"AIRLINE": [car], "AIRPORT": [air, air | {"direction": "TOTAL"}]}
    rows = rows[grain] if grain else [*rows["AIRLINE"], *rows["AIRPORT"]]
    keys = ["grain", "entity_key", "period", "direction"]
    b = base(spark, d).select("period", "qty", "disc", "tax", "doc", _each(*rows)).select("period", "qty", "disc", "tax", "doc", "x.*")
    g = b.groupBy(*keys).agg(F.sum("qty").alias("q"), (F.sum(c("qty") * F.round(100 + 100 * c("disc"))) / 100).alias("a"), (F.sum(c("qty") * F.round(100 * c("tax"))) / 100).alias("m"), F.countDistinct("doc").alias("docs"), F.count("*").alias("n"))
    pax = F.when(c("entity_key").isin("C00", "C05", "C10", "C15"), 0).otherwise(c("n") * 7).cast("double")
    long = lambda cs: F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in cs.items()])
    carriers = long({"ftk_million": c("q") / 1000, "atk_million": c("a") / 500, "freight_tonnes": c("q"), "mail_tonnes": c("m"), "cargo_total_tonnes": c("q") + c("m"), "departures": c("docs").cast("double"), "pax_carried": pax})
    airports = long({"aircraft_movements": c("docs").cast("double"), "pax_carried": (c("n") * 10).cast("double")})
    each = F.explode(F.when(c("grain") == "AIRLINE", carriers).otherwise(airports)).alias("x")
    return g.select(*keys, each).select(*keys, "x.*", periods.sort_key(c("period")).alias("sort_key"))


METRIC_ONLY = """cm AS (
  SELECT airline_name AS entity_key, period, sum(qty) AS q, sum(qty * round(100 + 100 * disc)) / 100 AS a, sum(qty * round(100 * tax)) / 100 AS m, count(DISTINCT doc) AS docs, count(*) AS n FROM base GROUP BY ALL),
am AS (
  SELECT airport_iata AS entity_key, period, direction, count(DISTINCT doc) AS docs, count(*) AS n FROM base GROUP BY ALL
  UNION ALL SELECT airport_iata, period, 'TOTAL', count(DISTINCT doc), count(*) FROM base GROUP BY ALL),
metric AS (
  SELECT *, CAST(period[1:4] AS INTEGER) * 100 + CAST(period[6:7] AS INTEGER) AS sort_key FROM (
  SELECT 'AIRLINE' AS grain, entity_key, period, 'TOTAL' AS direction, unnest(['ftk_million', 'atk_million', 'freight_tonnes', 'mail_tonnes', 'cargo_total_tonnes', 'departures', 'pax_carried']) AS metric,
    unnest([q / 1000, a / 500, q, m, q + m, CAST(docs AS DOUBLE), CASE WHEN entity_key IN ('C00', 'C05', 'C10', 'C15') THEN 0.0 ELSE CAST(n * 7 AS DOUBLE) END]) AS value FROM cm
  UNION ALL SELECT 'AIRPORT', entity_key, period, direction, unnest(['aircraft_movements', 'pax_carried']), unnest([CAST(docs AS DOUBLE), CAST(n * 10 AS DOUBLE)]) FROM am))"""
METRIC = f"{BASE}, {METRIC_ONLY}"


def airports(spark: SparkSession, d: str) -> DataFrame:
    """[T3] One name for each code."""
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity_key"), F.col("n_name").alias("airport_name"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """[W-15] Carrier by airport series with empty months as zeros, so that
    services start and stop; months come from a calendar, not from the data."""
    b = base(spark, d).where("period < '2001-08'").groupBy(F.concat_ws("-", "airline_name", "airport_iata").alias("entity_key"), "period").agg((F.sum("qty") * 1000).alias("kg"))
    months = F.transform(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-07-01").cast("date"), F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))
    grid = b.groupBy("entity_key").agg(F.map_from_entries(F.collect_list(F.struct("period", "kg"))).alias("m")).select("entity_key", "m", F.explode(months).alias("period"))
    return grid.select(F.lit("ROUTE").alias("grain"), "entity_key", F.lit("TOTAL").alias("direction"), F.lit("freight").alias("measure"), "period", periods.sort_key(F.col("period")).alias("sort_key"), F.coalesce(F.get(F.array(F.try_element_at("m", "period")), F.lit(0)), F.lit(0.0)).alias("tonnage_kg"))


SPARSE = f"""{BASE}, routes AS (SELECT airline_name || '-' || airport_iata AS entity_key, period, sum(qty) * 1000 AS kg FROM base WHERE period < '2001-08' GROUP BY ALL),
months AS (SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH)) AS m)),
sparse AS (
  SELECT e.entity_key, m.period, CAST(m.period[1:4] AS INTEGER) * 100 + CAST(m.period[6:7] AS INTEGER) AS sort_key, coalesce(r.kg, 0.0) AS tonnage_kg
  FROM (SELECT DISTINCT entity_key FROM routes) e CROSS JOIN months m LEFT JOIN routes r ON r.entity_key = e.entity_key AND r.period = m.period)"""
