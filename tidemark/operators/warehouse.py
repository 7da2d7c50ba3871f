"""Upserts, retirement, name resolution, collisions and validation of facts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cells

NATURAL_KEY = ["grain", "period", "airport_iata", "airline_name", "direction", "publisher", "measure"]


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order; null keys are equal keys."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], updatable: list[str]) -> DataFrame:
    """[S-23, P-1, P-2] Rows of ``new`` (one for each key) inserted, or of those
    stored the ``updatable`` columns replaced; the others keep what they have.
    A union and one aggregation: a single shuffle, nothing joined."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *rest, F.lit(0).alias("_v")).unionByName(new.select(*keys, *rest, F.lit(1).alias("_v")))
    pick = lambda c: F.max_by(c, "_v") if c in updatable else F.min_by(c, "_v")
    return both.groupBy(*keys).agg(*[pick(c).alias(c) for c in rest]).select(*stored.columns)


def retire(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """[S-24, J-14] Stored rows that this run made again, and the retired ones."""
    made = new.select(*keys).distinct()
    return stored.join(made, same(stored, made, keys), "left_semi"), stored.join(made, same(stored, made, keys), "left_anti")


def collisions(facts: DataFrame) -> DataFrame:
    """[N-26] Within a document, one code for several names, or one row twice."""
    w = ["airport_iata", "period", "direction", "source_document_id"]
    found = facts.groupBy(*w).agg(F.count("*").alias("rows"), F.countDistinct("airport_name_raw").alias("names"))
    return found.where("rows > 1 or names > 1")


FLOOR = 0.86


def _primary(airports: DataFrame, key: str) -> DataFrame:
    """[N-8] Of the airports that share a key the one with a code and
    international; curated aliases before all."""
    primacy = F.when(F.col("iata").isNotNull(), 2).otherwise(0) + F.col("is_international").cast("int")
    curated = F.col("curated") if "curated" in airports.columns else F.lit(False)
    w = Window.partitionBy(key).orderBy(curated.desc(), primacy.desc(), "file_order")
    kept = airports.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return kept.select(F.upper(key).alias("key"), F.struct("iata", F.upper("country").alias("country"), "name").alias("at"))


def resolve(names: DataFrame, airports: DataFrame) -> DataFrame:
    """[N-9, N-25] Distinct ``names`` (raw, variants, country) to codes, step by
    step: a variant's exact name (0.75 where the countries differ); a bare code
    of three letters that isn't of another country; the most similar name of the
    country's airports (of all, where it has none) from ``FLOOR`` on."""
    asked = names.groupBy("raw", "country").agg(F.first("variants").alias("variants")).select("raw", "country", F.upper("country").alias("hint"), "variants")
    tried = asked.select("raw", "country", "hint", F.posexplode("variants").alias("pos", "key"))
    foreign = F.coalesce(F.col("at.country") != F.col("hint"), F.col("hint").isNotNull())
    method = F.when(foreign, "exact-name-country-mismatch").when(F.col("pos") == 0, "exact-name").otherwise("exact-variant")
    exact = tried.join(_primary(airports, "name"), "key").select("raw", "country", F.struct(F.lit(0).alias("step"), "pos", F.col("at.iata").alias("iata"), F.when(foreign, 0.75).otherwise(1.0).alias("confidence"), method.alias("method")).alias("hit"))
    codes = tried.where(F.length("key") == 3).join(_primary(airports, "iata"), "key").where(~foreign)
    codes = codes.select("raw", "country", F.struct(F.lit(1).alias("step"), "pos", F.col("at.iata").alias("iata"), F.lit(1.0).alias("confidence"), F.lit("iata").alias("method")).alias("hit"))
    known = exact.unionByName(codes).groupBy("raw", "country").agg(F.min("hit").alias("hit"))
    known = known.select("raw", "country", "hit.iata", "hit.confidence", "hit.method")
    left = asked.join(known.select(F.col("raw").alias("_raw"), F.col("country").alias("_country")), F.col("raw").eqNullSafe(F.col("_raw")) & F.col("country").eqNullSafe(F.col("_country")), "left_anti")
    close = fuzzy(left.select("raw", "country", F.get("variants", F.lit(0)).alias("name")).where("name is not null"), airports)
    close = close.select("raw", "country", "iata", F.lit(FLOOR).alias("confidence"), F.lit("fuzzy").alias("method"))
    none = left.select("raw", "country", F.lit(None).cast("string").alias("iata"), F.lit(0.0).alias("confidence"), F.when(F.size("variants") > 0, "unresolved").otherwise("empty").alias("method"))
    rest = none.unionByName(close).groupBy("raw", "country").agg(F.max_by(F.struct("iata", "confidence", "method"), "confidence").alias("x")).select("raw", "country", "x.*")
    return known.unionByName(rest)


def fuzzy(names: DataFrame, airports: DataFrame, floor: float = FLOOR) -> DataFrame:
    """[N-9] The most similar name among the country's airports, by the share of
    letters in matching blocks; of the few names that the exact steps left. Only
    pairs whose lengths and letters allow the share are measured."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            m = SequenceMatcher(None, y, x)
            out.append(m.ratio() if m.quick_ratio() >= floor else 0.0)
        return pd.Series(out, dtype="float64")

    pool = _primary(airports, "name").select(F.col("key").alias("match"), "at.iata", F.col("at.country").alias("home"))
    own = names.withColumn("hint", F.upper("country"))
    here = own.join(pool.select("home").distinct(), F.col("hint") == F.col("home"), "left").withColumn("hint", F.col("home")).drop("home")  # null: any country
    fits = 2 * F.least(F.length("name"), F.length("match")) >= floor * (F.length("name") + F.length("match"))
    inside = here.where("hint is not null").join(pool, (F.col("hint") == F.col("home")) & fits)
    sizes = F.explode(F.sequence(F.ceil(F.length("name") * floor / (2 - floor)).cast("int"), F.floor(F.length("name") * (2 - floor) / floor).cast("int")))
    outside = here.where("hint is null").withColumn("_n", sizes).join(pool.withColumn("_n", F.length("match")), "_n").drop("_n")
    scored = inside.unionByName(outside).withColumn("confidence", similarity("name", "match")).where(F.col("confidence") >= floor)
    best = scored.groupBy("raw", "country").agg(F.max_by(F.struct("iata", "match"), F.struct("confidence", "match")).alias("x"), F.max("confidence").alias("similarity"))
    return best.select("raw", "country", "x.iata", "x.match", "similarity")


def reconciled(facts: DataFrame, airports: DataFrame) -> DataFrame:
    """[N-10, N-25] Facts (grain, airport_iata, airport_icao, airport_name_raw,
    country) with the code, the confidence and how it was found: carriers have no
    airport, given codes stand, ICAO codes are looked up, names go through the cascade."""
    icao = _primary(airports.withColumnRenamed("icao", "_icao"), "_icao").select(F.col("key").alias("_code"), F.col("at.iata").alias("_by_icao"))
    left = (F.col("grain") != "AIRLINE") & F.col("airport_iata").isNull() & F.col("airport_icao").isNull()
    names = facts.where(left).select(F.col("airport_name_raw").alias("raw"), "country").distinct().withColumn("variants", cells.name_variants(F.col("raw")))
    found = resolve(names, airports).select(F.col("raw").alias("_raw"), F.col("country").alias("_country"), F.col("iata").alias("_iata"), F.col("confidence").alias("_confidence"), F.col("method").alias("_method"))
    told = F.when(left, F.col("airport_name_raw"))
    out = facts.join(icao, F.upper(F.trim("airport_icao")) == F.col("_code"), "left").join(found, told.eqNullSafe(F.col("_raw")) & F.col("country").eqNullSafe(F.col("_country")) & left, "left")
    sure = F.col("_confidence") >= FLOOR
    code = F.coalesce("airport_iata", F.when(F.col("grain") != "AIRLINE", F.coalesce("_by_icao", F.when(sure, F.col("_iata")))))
    method = F.when(F.col("grain") == "AIRLINE", "airline-grain").when(F.col("airport_iata").isNotNull(), "pre-resolved").when(F.col("airport_icao").isNotNull(), "icao").otherwise(F.coalesce("_method", F.lit("empty")))
    score = F.when(left, F.coalesce("_confidence", F.lit(0.0))).otherwise(1.0)
    return out.select(*[c for c in facts.columns if c != "airport_iata"], code.alias("airport_iata"), score.alias("resolution_confidence"), method.alias("resolution_method"))


def review_names(judged: DataFrame) -> DataFrame:
    """[N-28] The distinct names of quarantined rows, in order."""
    return judged.where("airport_name_raw is not null").groupBy("airport_name_raw").agg(F.count("*").alias("rows")).orderBy("airport_name_raw")


def split_valid(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[F-11, N-27] Facts that meet the constraints, and the others with a reason."""
    reason = (
        F.when(F.col("source_document_id").isNull(), "no provenance")
        .when(F.col("tonnage_kg").isNull() | (F.col("tonnage_kg") < 0), "tonnage out of range")
        .when((F.col("grain") == "AIRPORT") & F.col("airport_iata").isNull(), "no airport")
        .when((F.col("grain") == "AIRLINE") & F.col("airline_name").isNull(), "no airline")
    )
    judged = facts.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def extraction_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """[N-24] Yield, share resolved and warnings of each extraction."""
    g = rows.groupBy(*by).agg(F.sum("kept").alias("k"), F.sum("seen").alias("s"), F.sum("resolved").alias("r"), F.sum("warnings").alias("w"))
    raw = 0.6 * F.coalesce(F.try_divide("k", "s"), F.lit(0.0)) + 0.4 * F.coalesce(F.try_divide("r", "k"), F.lit(0.0)) - F.least(F.lit(0.3), 0.05 * F.col("w"))
    return g.select(*by, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3).alias("score"))


def dimension(rows: DataFrame, keys: list[str], first: list[str], last: list[str], order: str) -> DataFrame:
    """[P-1] One row for each entity: ``first`` columns from its earliest row,
    ``last`` columns from its latest."""
    picks = [F.min_by(c, order).alias(c) for c in first] + [F.max_by(c, order).alias(c) for c in last]
    return rows.groupBy(*keys).agg(*picks, F.count("*").alias("rows_"))


def traffic(rows: DataFrame, keys: list[str], value: str, document: str) -> DataFrame:
    """[P-5] Rows with a code summed by key, with the documents behind them."""
    return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("value"), F.countDistinct(document).alias("documents"))
