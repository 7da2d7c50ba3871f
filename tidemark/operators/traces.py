"""Agent traces as a table, and questions to the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intents by their patterns, in order; the first match counts.
INTENTS = (
    ("airport_ranking", (r"\b(top|biggest|largest|busiest|rank|ranking)\b.*\bairport", r"\bairport.*\b(top|rank|ranking|growth|grew|growing)\b", r"\bwhich airports?\b")),
    ("airline_ranking", (r"\b(top|biggest|largest|rank|ranking)\b.*\b(airline|carrier)", r"\b(airline|carrier)s?\b.*\b(top|rank|most|share)\b", r"\bwhich (airline|carrier)s?\b")),
    ("anomaly_list", (r"\banomal", r"\bunusual\b", r"\bspike", r"\bdrop(ped)?\b", r"\bwhat.*\bwrong\b", r"\balert")),
    ("forecast_list", (r"\bforecast", r"\bpredict", r"\bproject(ion|ed)?\b", r"\bnext (quarter|month|year)\b", r"\bexpect")),
    ("airport_trend", (r"\btrend\b", r"\bover time\b", r"\bhistory\b", r"\bhow (has|did)\b.*\bchange")),
    ("source_list", (r"\bsource", r"\bwhere.*\bdata.*from\b", r"\bpublisher")),
)


def intent(question: Column) -> Column:
    """[G-1]"""
    low = F.lower(question)
    return F.coalesce(*[F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in INTENTS])


def asked_direction(question: Column) -> Column:
    """[G-2]"""
    low = F.lower(question)
    return F.when(low.contains("international"), "INTERNATIONAL").when(low.contains("domestic"), "DOMESTIC").otherwise("TOTAL")


def wants_growth(question: Column) -> Column:
    """[G-2]"""
    return F.lower(question).rlike(r"\b(grow|growth|grew|fastest|increase|rising)\b")


def asked_code(question: str, known: DataFrame) -> str | None:
    """[G-2] The first word of a question that is a code of the data (``entity_key``)."""
    words = [w.strip("?.,!").upper() for w in question.split()]
    held = {r[0] for r in known.where(F.col("entity_key").isin(*words)).select("entity_key").distinct().collect()}  # of the words
    return next((w for w in words if w in held), None)


def runs(steps: DataFrame) -> DataFrame:
    """[A-10, P-13] One row for each run: its agent, steps, time, use and policy."""
    g = steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.bool_and("ok").alias("succeeded"), F.sum("elapsed_ms").alias("ms"), F.min_by("tool", "seq").alias("agent"), F.sum("tokens").alias("tokens") if "tokens" in steps.columns else F.lit(0).alias("tokens"))
    return g.join(effective_policy(steps).drop("failed_steps"), "run_id")


def tool_stats(steps: DataFrame) -> DataFrame:
    """[A-8]"""
    return steps.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"), F.countDistinct("run_id").alias("runs"))


def rollup(steps: DataFrame) -> DataFrame:
    """[A-9]"""
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("elapsed_ms").alias("total_ms"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))


def effective_policy(steps: DataFrame) -> DataFrame:
    """[J-19] What a run was really decided by."""
    g = steps.groupBy("run_id").agg(F.count_if(~F.col("ok")).alias("failed_steps"), F.count_if(F.col("policy") == "model").alias("m"), F.count_if(F.col("policy").startswith("heuristic (")).alias("f"))
    return g.select("run_id", "failed_steps", F.when(F.col("m") == 0, "heuristic").when(F.col("f") > 0, "mixed").otherwise("model").alias("effective_policy"))


def sessions(steps: DataFrame, start: str) -> DataFrame:
    """[S-26] Steps numbered by the ``start`` tool's calls so far."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return steps.withColumn("session", F.sum((F.col("tool") == start).cast("long")).over(w))


def spinning(steps: DataFrame) -> DataFrame:
    """[W-28] Calls that failed as the same call (tool and arguments) of their run
    last failed, by the first 120 characters of what was observed."""
    w = Window.partitionBy("run_id", "tool", "args").orderBy("seq")
    words = F.left("observation", F.lit(120))
    failed = steps.where(~F.col("ok")).withColumn("_o", F.lag(words).over(w))
    return failed.where(F.col("_o") == words).drop("_o")


def arms(steps: DataFrame) -> DataFrame:
    """[A-26] Steps, success and time of each arm of an experiment."""
    r = steps.groupBy("arm", "run_id").agg(F.count("*").alias("steps"), F.bool_and("ok").alias("success"), F.sum("elapsed_ms").alias("ms"))
    return r.groupBy("arm").agg(F.count("*").alias("runs"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.median("steps").alias("median_steps"), F.round(100.0 * F.count_if("success") / F.count("*"), 6).alias("success_pct"), F.round(F.avg("ms"), 6).alias("ms_per_doc"))
