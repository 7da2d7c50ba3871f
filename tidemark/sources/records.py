"""[S-8] Record payloads of an open-data catalogue, whose columns are told by
their names. Two grains: rows that name an airport, and rows of the one carrier
that the title names.

All is column expressions over one row for each document; only the year that a
header row sets for the rows below it needs the records in order, within their
document. Payloads that can't be read, have no mass column or name no carrier
give no fact but a reason. A null payload counts as unreadable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells, periods

# Words of column names, strongest first.
AIRPORT_HINTS = ("airport", "aerodrome", "station", "airports")
TONNAGE_HINTS = ("freight", "cargo", "tonnage", "tonnes", "tonne", "quantity", "weight")
PERIOD_HINTS = ("year", "month", "period", "date", "quarter", "fy")
PREFERRED = ("total", "freight", "cargo")
# Words of columns that hold a rate or a specification, no mass moved.
NO_MASS = (
    "percent", "growth", "_kms", "kilometer", "kilometre", "factor", "per_", "ratio", "productivity",
    "capacity", "payload", "installed", "seats", r"\bsize\b", "m c t o", "mctom", "available",
)
PAYLOAD = "struct<index_name:string,title:string,records:array<map<string,string>>>"


def _first(columns: Column, test) -> Column:
    return F.get(F.filter(columns, test), F.lit(0))


def picked(columns: Column, hints: Sequence[str]) -> Column:
    """[N-16] The column that a hint names outright, else one that holds a hint;
    an earlier hint counts before an earlier column."""
    plain = lambda c: F.regexp_replace(F.lower(c), "_", " ")
    named = lambda h: _first(columns, lambda c: F.trim(plain(c)) == F.lit(h))
    held = lambda h: _first(columns, lambda c: F.contains(plain(c), F.lit(h)))
    return F.coalesce(*map(named, hints), *map(held, hints))


def mass_column(columns: Column) -> Column:
    """[N-17] The column of the mass moved, totals before parts."""
    rate = "(?i)" + "|".join(NO_MASS)
    safe = F.filter(columns, lambda c: ~F.regexp_replace(c, r"[_.\-]+", " ").rlike(rate))
    hint = "|".join(TONNAGE_HINTS)
    best = lambda w: _first(safe, lambda c: F.contains(F.lower(c), F.lit(w)) & F.lower(c).rlike(hint))
    return F.coalesce(*map(best, PREFERRED), picked(safe, TONNAGE_HINTS))


def suitability(payload: Column) -> Column:
    """[S-22] How well the parser suits a payload: 0.9 for the catalogue's envelope."""
    keys = F.json_object_keys(payload)
    envelope = F.array_contains(keys, "records") & (F.array_contains(keys, "field") | F.array_contains(keys, "index_name"))
    return F.when(F.coalesce(envelope, F.lit(False)), 0.9).otherwise(0.0)


def mapped(payloads: DataFrame) -> DataFrame:
    """``doc_id`` with ``title``, ``records``, the columns chosen and, where the
    payload is refused, the ``reason``."""
    body = payloads.select("doc_id", F.from_json("payload", PAYLOAD).alias("p"))
    columns = F.map_keys(F.get("p.records", F.lit(0)))
    c = body.select("doc_id", F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.records").alias("records"), picked(columns, AIRPORT_HINTS).alias("airport_col"), mass_column(columns).alias("mass_col"), picked(columns, PERIOD_HINTS).alias("period_col"))
    c = c.withColumn("airline", F.when(F.col("airport_col").isNull(), cells.carrier(F.col("title"))))
    reason = F.when(F.coalesce(F.size("records"), F.lit(0)) < 1, "no records").when(F.col("mass_col").isNull(), "no mass column").when(F.col("airport_col").isNull() & F.col("airline").isNull(), "no carrier")
    return c.withColumn("reason", reason)


def parsed(payloads: DataFrame) -> DataFrame:
    """Facts of ``payloads`` (doc_id, payload: JSON text): one for each record with a mass."""
    m = mapped(payloads).where("reason is null")
    rows = m.select("*", F.posexplode("records").alias("rec_no", "rec")).drop("records")
    cell = lambda c: F.try_element_at("rec", F.col(c))
    label = F.trim(cell("period_col"))
    below = Window.partitionBy("doc_id").orderBy("rec_no")
    rows = rows.withColumn("label", F.nullif(label, F.lit(""))).withColumn("_year", F.last(periods.header_year(F.col("label")), ignorenulls=True).over(below))
    title = F.concat_ws(" ", "title", "mass_col")
    period = F.coalesce(periods.row_period(F.col("label"), F.col("_year")), periods.title_year(F.col("title")), F.lit("unknown"))
    grain = F.when(F.col("airport_col").isNull(), "AIRLINE").otherwise("AIRPORT")
    mass = cells.number(cell("mass_col"))
    name = F.when(F.col("airport_col").isNotNull(), F.trim(cell("airport_col")))
    facts = rows.select(
        F.col("doc_id").alias("source_document_id"), "rec_no", grain.alias("grain"), name.alias("airport_name_raw"), "airline", period.alias("period"), cells.direction(title).alias("direction"),
        cells.kilograms(mass, cells.unit_of(F.col("mass_col"))).alias("tonnage_kg"), F.when(grain == "AIRLINE", cells.measure_slug(F.col("title"), F.col("mass_col"))).otherwise("freight").alias("measure"),
        F.coalesce(cells.is_aggregate(F.col("airline")), F.lit(False)).alias("is_aggregate"),
    )
    return facts.where(F.col("tonnage_kg").isNotNull() & ((F.col("grain") == "AIRLINE") | (F.col("airport_name_raw") != "")))
