"""Registered queries: record payloads, name resolution in full, period hints,
parser ranking, and loads of dimensions and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import warehouse
from tidemark.plans import proxy
from tidemark.plans.proxy import table
from tidemark.plans.registry import query
from tidemark.sources import readers, records

_TITLES = (
    "Cargo handled at airports",
    "Operating Statistics on International Services of Blue Air from 1995-96 to 2001-02",
    "Monthly cargo of All Carriers during 1999",
    "Fleet of Green Air in 2001",
)
_FY = "CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')"


def payloads(spark, d):
    """A payload for each customer with orders, in one of four forms."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.withColumn("rec", F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")))
    y, price = F.year("o_orderdate"), F.format_string("%.2f", "o_totalprice")
    fy = F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    month = F.upper(F.date_format("o_orderdate", "MMM"))
    k = F.col("c_custkey") % 4
    cells_ = F.when(k == 0, F.create_map(F.lit("Airport_Name"), F.col("n_name"), F.lit("growth_pct_per_year"), F.lit("5"), F.lit("Freight_Tonnes"), price, F.lit("Year"), y.cast("string")))
    cells_ = cells_.when(k == 1, F.create_map(F.lit("_year"), fy, F.lit("percentage_growth_cargo"), F.lit("5"), F.lit("cargo_carried_kg___total"), price, F.lit("freight_kg"), F.lit("1")))
    cells_ = cells_.when(k == 2, F.create_map(F.lit("year_month"), F.when(F.col("rec") % 3 == 1, fy).otherwise(month), F.lit("quantity"), F.when(F.col("rec") % 3 == 1, "-").otherwise(price)))
    cells_ = cells_.otherwise(F.create_map(F.lit("year"), y.cast("string"), F.lit("cargo_payload_capacity"), price))
    title = F.get(F.array(*map(F.lit, _TITLES)), k.cast("int"))
    g = o.select("c_custkey", "rec", title.alias("title"), cells_.alias("cells")).groupBy("c_custkey", "title").agg(F.array_sort(F.collect_list(F.struct("rec", F.map_entries("cells").alias("cells")))).alias("r"))
    return g.select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.lit("x").alias("index_name"), "title", F.transform("r", lambda x: F.map_from_entries(x["cells"])).alias("records"))).alias("payload"))


@query("record_parser", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rec, c_custkey % 4 AS k, printf('%.2f', o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  h AS (SELECT *, last_value(CASE WHEN rec % 3 = 1 THEN year(o_orderdate) END IGNORE NULLS) OVER (PARTITION BY c_custkey ORDER BY rec) AS hy FROM o)
  SELECT c_custkey AS source_document_id, CAST(rec - 1 AS INTEGER) AS rec_no, CASE k WHEN 0 THEN 'AIRPORT' ELSE 'AIRLINE' END AS grain, CASE k WHEN 0 THEN n_name END AS airport_name_raw, CASE k WHEN 1 THEN 'Blue Air' WHEN 2 THEN 'All Carriers' END AS airline,
    CASE k WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) || '-A' WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '-FY' ELSE CAST(hy + CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END AS period,
    CASE k WHEN 1 THEN 'INTERNATIONAL' ELSE 'TOTAL' END AS direction, CAST(price AS DOUBLE) * CASE k WHEN 1 THEN 1.0 ELSE 1000.0 END AS tonnage_kg,
    CASE k WHEN 0 THEN 'freight' WHEN 1 THEN 'operating-international-services-blue-air' ELSE 'monthly-cargo-all-carriers' END AS measure, k = 2 AS is_aggregate
  FROM h WHERE k < 2 OR (k = 2 AND rec % 3 <> 1)""")
def record_parser(spark, d):
    """[S-8, N-15 to N-22]"""
    return records.parsed(payloads(spark, d))


@query("record_refusals", """SELECT coalesce(CASE c_custkey % 4 WHEN 3 THEN 'no mass column' END, 'parsed') AS reason, CASE c_custkey % 4 WHEN 0 THEN 'Freight_Tonnes' WHEN 1 THEN 'cargo_carried_kg___total' WHEN 2 THEN 'quantity' END AS mass_col, CASE c_custkey % 4 WHEN 0 THEN 'Year' WHEN 1 THEN '_year' WHEN 2 THEN 'year_month' ELSE 'year' END AS period_col, 0.9 AS suits, count(*) AS payloads
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY ALL""")
def record_refusals(spark, d):
    """[S-8, S-22, N-16, N-17] The columns chosen, and payloads refused."""
    p = payloads(spark, d)
    m = records.mapped(p).join(p.select("doc_id", records.suitability(F.col("payload")).alias("suits")), "doc_id")
    return m.groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason"), "mass_col", "period_col", "suits").agg(F.count("*").alias("payloads"))


_ASKED = """asked AS (SELECT s_suppkey, n_name, n_regionkey, s_suppkey % 8 AS k, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("reconciliation_cascade", f"""WITH {_ASKED} SELECT s_suppkey, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'XYZ' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE code END AS airport_iata, CASE k WHEN 6 THEN 0.75 WHEN 7 THEN 0.0 WHEN 5 THEN 0.86 ELSE 1.0 END AS resolution_confidence,
  CASE k WHEN 0 THEN 'airline-grain' WHEN 1 THEN 'pre-resolved' WHEN 2 THEN 'icao' WHEN 3 THEN 'exact-variant' WHEN 4 THEN 'iata' WHEN 5 THEN 'fuzzy' WHEN 6 THEN 'exact-name-country-mismatch' ELSE 'unresolved' END AS resolution_method FROM asked""")
def reconciliation_cascade(spark, d):
    """[N-8 to N-10, N-25] Every step: grain, given code, ICAO, exact variant,
    bare code, fuzzy in the country's pool, another country, nothing."""
    n = table(spark, d, "nation")
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    long = F.concat("n_name", F.lit(" CENTRAL FIELD"))
    a = n.select(F.upper(long).alias("name"), code.alias("iata"), F.concat(F.lit("ICAO"), "n_nationkey").alias("icao"), F.col("n_regionkey").cast("string").alias("country"), F.lit(True).alias("is_international"), F.col("n_nationkey").alias("file_order"))
    k = F.col("s_suppkey") % 8
    raw = F.when(k.isin(3, 6), F.concat(long, F.lit(" (cargo)"))).when(k == 4, code).when(k == 5, F.concat("n_name", F.lit(" CENTRAL FIELDS"))).otherwise(F.lit("somewhere else"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    facts = s.select("s_suppkey", F.when(k == 0, "AIRLINE").otherwise("AIRPORT").alias("grain"), F.when(k == 1, "XYZ").alias("airport_iata"), F.when(k == 2, F.concat(F.lit("icao"), "n_nationkey")).alias("airport_icao"), raw.alias("airport_name_raw"), F.when(k == 6, "nowhere").otherwise(F.col("n_regionkey").cast("string")).alias("country"))
    return warehouse.reconciled(facts, a).select("s_suppkey", F.when(F.col("resolution_confidence") >= warehouse.FLOOR, F.col("airport_iata")).alias("airport_iata"), "resolution_confidence", "resolution_method")


@query("review_queue_names", "SELECT n_name AS airport_name_raw, count(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0 GROUP BY ALL")
def review_queue_names(spark, d):
    """[N-28] Names of rows whose tonnage is out of range."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    facts = s.select(F.col("s_suppkey").alias("source_document_id"), F.col("s_acctbal").alias("tonnage_kg"), F.lit("AIRPORT").alias("grain"), F.lit("X").alias("airport_iata"), F.lit(None).cast("string").alias("airline_name"), F.col("n_name").alias("airport_name_raw"))
    return warehouse.review_names(warehouse.split_valid(facts)[1])


@query("period_hints", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS from_name, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m') END AS from_header, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m') END AS from_mixed FROM orders""")
def period_hints(spark, d):
    """[S-6, S-20] From file names, plain headers and headers of interleaved scripts."""
    at, y = "o_orderdate", F.year("o_orderdate").cast("string")
    url = F.concat(F.lit("https://x.example/files/"), F.date_format(at, "MMMM"), F.when(F.year(at) >= 2000, F.concat(F.lit("2k"), F.substring(y, 3, 2))).otherwise(y), F.lit("Annex4.pdf"))
    plain = F.concat(F.lit("FREIGHT 17-2010 FOR "), F.upper(F.date_format(at, "MMMM")), F.lit(", "), y, F.lit(" (MT)"))
    mon = F.upper(F.date_format(at, "MMM"))
    mixed = F.concat_ws(" ", F.lit("माह"), F.substring(mon, 1, 1), F.lit("सि"), F.substring(mon, 2, 1), F.lit("तं"), F.substring(mon, 3, 1), F.lit("ब"), y)
    return table(spark, d, "orders").select("o_orderkey", periods.filename_period(url).alias("from_name"), periods.header_period(plain).alias("from_header"), periods.header_period(mixed).alias("from_mixed"))


@query("parser_ranking", """SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['records'] WHEN 1 THEN ['cube', 'records'] ELSE [] END) AS parser, unnest(CASE p_partkey % 3 WHEN 0 THEN [1] WHEN 1 THEN [1, 2] ELSE [] END) AS place FROM part""")
def parser_ranking(spark, d):
    """[S-22] Parsers by suitability; those that score nothing are left out."""
    k = F.col("p_partkey") % 3
    scores = table(spark, d, "part").select("p_partkey", F.explode(F.create_map(F.lit("records"), F.when(k == 2, 0.0).otherwise(0.9), F.lit("cube"), F.when(k == 1, 0.95).otherwise(0.0), F.lit("annexure"), F.lit(0.0))).alias("parser", "score"))
    return readers.ranked_parsers(scores, ["p_partkey"])


@query("runnable_sources", "SELECT n_nationkey AS key, n_name FROM nation WHERE n_nationkey % 3 = 0 OR (n_nationkey % 3 = 1 AND n_nationkey % 2 = 0)")
def runnable_sources(spark, d):
    """[S-21] Active sources, and those that lack a credential no more."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    sources = n.select(k.alias("key"), "n_name", F.when(k % 3 == 0, "ACTIVE").when(k % 3 == 1, "NEEDS_CREDENTIAL").otherwise("UNAVAILABLE").alias("status"))
    return readers.runnable(sources, n.where("n_nationkey % 2 = 0").select(k.alias("key"))).select("key", "n_name")


@query("dimension_upserts", """SELECT airport_iata AS entity_key, arg_min(airport_name, doc) AS airport_name, arg_max(publisher, doc) AS publisher, count(*) AS rows_ FROM (SELECT DISTINCT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS airport_iata, n_name AS airport_name, o_orderpriority AS publisher, o_orderkey AS doc FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL""")
def dimension_upserts(spark, d):
    """[P-1] Of an entity's rows the first names it, the last refreshes what may change."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("entity_key"), F.col("n_name").alias("airport_name"), F.col("o_orderpriority").alias("publisher"), F.col("o_orderkey").alias("doc"))
    return warehouse.dimension(rows, ["entity_key"], ["airport_name"], ["publisher"], "doc")


@query("operating_metric_load", "SELECT p_partkey, metric, max(value) AS value FROM (SELECT p_partkey, 'freight_tonnes' AS metric, p_size + 1.0 AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'freight_tonnes', CAST(p_size AS DOUBLE) FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'departures', p_retailprice FROM part) GROUP BY ALL")
def operating_metric_load(spark, d):
    """[P-4] Mined metrics of this run over those stored."""
    p = table(spark, d, "part")
    stored = readers.operating_metrics(p.select("p_partkey", F.col("p_size").cast("double").alias("cargo_carried_ton__freight"), F.col("p_retailprice").alias("aircraft_flown_departures")), ["p_partkey"])
    new = readers.operating_metrics(p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 1.0).alias("cargo_carried_ton__freight")), ["p_partkey"])
    return warehouse.upsert(stored, new, ["p_partkey", "metric"], ["value"])


@query("traffic_load", f"""WITH {proxy.BASE} SELECT airport_iata, period, direction, sum(qty) AS value, count(DISTINCT doc) AS documents FROM base WHERE airport_iata <> 'N03' GROUP BY ALL""")
def traffic_load(spark, d):
    """[P-5] Movements by airport; rows that name no code are skipped."""
    b = proxy.base(spark, d).withColumn("airport_iata", F.when(F.col("airport_iata") != "N03", F.col("airport_iata")))
    return warehouse.traffic(b, ["airport_iata", "period", "direction"], "qty", "doc")


@query("catalogue_mapping", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'b' || CAST(page_id AS VARCHAR) ELSE 'c' || CAST(page_id AS VARCHAR) END AS title, page_id % 3 = 1 AS relevant FROM pages")
def catalogue_mapping(spark, d):
    """[P-8] The first spelling of a field that holds something, and relevance."""
    k, i = F.col("page_id") % 3, F.col("page_id").cast("string")
    note = F.when(k == 1, "air cargo by airport").otherwise("nothing of it")
    rows = table(spark, d, "pages").select("page_id", F.create_map(F.lit("title"), F.when(k == 0, F.concat(F.lit("a"), i)).otherwise(" "), F.lit("name"), F.when(k == 1, F.concat(F.lit("b"), i)), F.lit("desc"), F.concat(F.lit("c"), i), F.lit("note"), note).alias("fields"))
    return readers.catalogue(rows, {"title": ["title", "name", "desc"], "note": ["note"]}).select("page_id", "title", "relevant")
