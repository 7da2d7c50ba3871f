"""Scans and decoders of published material."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import cells

FACT_SCHEMA = "airport_name_raw string, period string, direction string, tonnage_kg double, source_document_id string, publisher string, airport_iata string, airport_icao string, airport_name string, country string, prior_year_tonnage_kg double, reported_change_pct double, resolution_confidence double, resolution_method string, grain string, airline string, is_aggregate boolean, measure string"

#: Canonical metrics by the pattern of a column's name, first match wins.
METRIC_PATTERNS = (
    ("ftk_million", r"ton_?_?kms?_performed.*freight"),
    ("mail_tk_million", r"ton_?_?kms?_performed.*mail"),
    ("ttk_million", r"ton_?_?kms?_performed.*total"),
    ("pax_tk_million", r"ton_?_?kms?_performed.*pax"),
    ("atk_million", r"available_tonne_kilomet"),
    ("ask_million", r"available_seat_kilomet"),
    ("rpk_million", r"passengers?_+kms?_performed"),
    ("weight_load_factor", r"^weight_load_factor"),
    ("pax_load_factor", r"^pax_load_factor"),
    ("freight_tonnes", r"cargo_carried_ton_+freight"),
    ("mail_tonnes", r"cargo_carried_ton_+mail"),
    ("cargo_total_tonnes", r"cargo_carried_ton_+total"),
    ("departures", r"aircraft_flown_+departures"),
    ("block_hours", r"aircraft_flown_+hours"),
    ("distance_thousand_km", r"aircraft_flown_+kms_thousand"),
    ("pax_carried", r"passengers?_+carried"),
    ("freight_inbound_tonnes", r"freight_tonne_+to_india"),
    ("freight_outbound_tonnes", r"freight_tonne_+from_india"),
)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """[S-1] Facts, a JSON object a line."""
    return spark.read.schema(FACT_SCHEMA).json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """[S-2] Provenance rows; of a repeated ``doc_id`` the later line."""
    rows = spark.read.schema("doc_id string, publisher string, source_url string, sha256 string, media_type string, byte_size long, raw_path string, published_on string, status string, discovered_at string").json(path)
    w = Window.partitionBy("doc_id").orderBy(F.desc("_n"))
    return rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r")


def crosswalk(spark: SparkSession, bulk: str, aliases: str | None = None) -> DataFrame:
    """[S-3, S-4] Airports from a bulk file without a header (``\\N``: none, short
    rows dropped), under curated aliases, which come first."""
    names = ["airport_id", "airport_name", "city", "country", "iata", "icao", "latitude", "longitude", "altitude", "offset", "dst", "timezone"]
    raw = spark.read.csv(bulk, schema=", ".join(f"{n} string" for n in names), nullValue="\\N").where(F.col("timezone").isNotNull())
    base = raw.select(F.upper("airport_name").alias("name"), "iata", "icao", "city", "country", F.lit(1).alias("precedence"))
    if aliases is None:
        return base
    top = spark.read.csv(aliases, header=True).select(F.upper("alias").alias("name"), "iata", "icao", "city", "country", F.lit(0).alias("precedence"))
    return top.unionByName(base)


def metric_of(column: Column) -> Column:
    """[S-10] The canonical metric of a column's name."""
    low = F.lower(F.trim(column))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(m)) for m, p in METRIC_PATTERNS])


def operating_metrics(wide: DataFrame, ids: list[str]) -> DataFrame:
    """[S-10] Wide tables to (ids, metric, value); unknown columns are left out."""
    rest = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, rest, "column", "value")
    return long.withColumn("metric", metric_of(F.col("column"))).where("metric is not null and value is not null").select(*ids, "metric", F.col("value").cast("double").alias("value"))


def json_stat(cells: DataFrame, dims: list[tuple[str, list[str]]]) -> DataFrame:
    """[S-9] A dense cube's flat (idx, value) cells with a column for each
    dimension, by row-major strides."""
    out, stride = cells, 1
    for name, labels in reversed(dims):
        at = F.pmod(F.floor(F.col("idx") / stride), F.lit(len(labels))).cast("int")
        out = out.withColumn(name, F.get(F.array(*map(F.lit, labels)), at))
        stride *= len(labels)
    return out


def links(pages: DataFrame, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """[S-17] Distinct absolute links of each page."""
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    found = pages.select("page_id", host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))).alias("href"))
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.concat(F.col("host"), F.lit("/"), F.col("href")))
    return found.select("page_id", absolute.alias("link")).distinct()


def laddered(links_: DataFrame, ladder: list[str]) -> DataFrame:
    """[S-18] Links by the first pattern of the ladder that any of a page's match."""
    rung = F.coalesce(*[F.when(F.col("link").rlike(p), F.lit(i)) for i, p in enumerate(ladder)])
    best = F.min("rung").over(Window.partitionBy("page_id"))
    return links_.withColumn("rung", rung).withColumn("best", best).where("rung = best").select("page_id", "link", "rung")


def probes(known: DataFrame, template: str, first: str, last: str) -> DataFrame:
    """[S-19] URLs of a month's sequence that aren't known yet."""
    months = known.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("m"))
    urls = months.select(F.format_string(template, F.year("m"), F.month("m")).alias("url"))
    return urls.join(known.select("url"), "url", "left_anti")


def api_urls(spark: SparkSession, template: str, parameters: dict[str, list[str]]) -> DataFrame:
    """[S-16] Every combination of a few parameters in a URL template."""
    one = spark.range(1).select(F.lit(template).alias("url"))
    return reduce(lambda df, kv: df.withColumn("_v", F.explode(F.array(*map(F.lit, kv[1])))).select(F.replace("url", F.lit("{" + kv[0] + "}"), F.col("_v")).alias("url")), parameters.items(), one)


def archived(payloads: DataFrame, ledger_: DataFrame) -> DataFrame:
    """[S-14] Payloads not yet archived, one for each content hash."""
    keyed = payloads.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return keyed.join(ledger_.select("sha256"), "sha256", "left_anti")


def carried_sections(rows: DataFrame) -> DataFrame:
    """[S-5, S-7] The section of each table row: the last heading before it in
    its document, also over page ends. ``rows``: doc_id, page, line, text."""
    heading = F.coalesce(F.when(F.upper("text").contains("INTERNATIONAL"), "INTERNATIONAL"), F.when(F.upper("text").contains("DOMESTIC"), "DOMESTIC"), F.when(F.upper("text").rlike(r"\bTOTAL\b"), "TOTAL"))
    w = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def ranked_parsers(scores: DataFrame, keys: list[str]) -> DataFrame:
    """[S-22] Parsers by how well they suit, best first; none that doesn't."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "parser")
    return scores.where("score > 0").withColumn("place", F.row_number().over(w)).select(*keys, "parser", "place")


def runnable(sources: DataFrame, credentials: DataFrame) -> DataFrame:
    """[S-21] Sources that can run now: the credential counts when asked."""
    held = credentials.select(F.col("key").alias("_key")).distinct()
    ready = (F.col("status") == "ACTIVE") | ((F.col("status") == "NEEDS_CREDENTIAL") & F.col("_key").isNotNull())
    return sources.join(held, F.col("key") == F.col("_key"), "left").where(ready).select(*sources.columns)


def catalogue(rows: DataFrame, spellings: dict[str, list[str]]) -> DataFrame:
    """[P-8] Each field from the first of its spellings that holds something;
    ``relevant`` by the terms of all of them."""
    held = lambda k: F.nullif(F.trim(F.try_element_at("fields", F.lit(k))), F.lit(""))
    found = {name: F.coalesce(*map(held, keys)) for name, keys in spellings.items()}
    return rows.withColumns(found).withColumn("relevant", F.size(cells.relevance(F.concat_ws(" ", *found))) > 0)
