"""The monthly brief: small frames, rendered on the driver. [G-6, G-8, S-27, P-20]"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import series, structure


def clip(label: str, most: int = 26) -> str:
    return label if len(label) <= most else label[: most - 1] + "…"


def signed_pct(value: float | None) -> str:
    return "n/a" if value is None else f"{value:+.1f}%"


def build(facts: DataFrame, period: str | None = None) -> dict[str, list[dict]]:
    """Totals, top ten, movers, alerts and forecasts of a month; each frame is
    limited before it is collected."""
    period = period or facts.where("period_kind = 'MONTH'").agg(F.max_by("period", "sort_key")).head()[0]
    now = facts.where((F.col("grain") == "AIRPORT") & (F.col("period") == period))
    total = now.groupBy("direction").agg((F.sum("tonnage_kg") / 1000).alias("mt")).orderBy("direction")
    by = now.where("direction = 'TOTAL'").groupBy("airport_iata", "airport_name").agg(F.sum("tonnage_kg").alias("t"), F.sum("prior_year_tonnage_kg").alias("p"))
    growth = F.try_divide(F.col("t") - F.col("p"), F.col("p")) * 100
    named = by.select("airport_iata", "airport_name", (F.col("t") / 1000).alias("mt"), growth.alias("growth_pct"), "t", "p")
    s = series.build(facts)
    alerts = series.one_alert(series.statistical(s).where(series.is_material())).where(F.col("period") == period)
    frames = {
        "totals": total,
        "top": named.orderBy(F.desc("mt"), "airport_iata").limit(10),
        "movers": named.where("t >= 100000 and p > 0").orderBy(F.abs("growth_pct").desc(), "airport_iata").limit(8),
        "alerts": alerts.orderBy(F.abs("deviation_pct").desc(), "entity_key").limit(8),
        "forecasts": series.forecasts(s).where("horizon = 1").orderBy(F.desc("predicted_kg"), "entity_key").limit(6),
        "concentration": structure.concentration(by.withColumn("period", F.lit(period)), ["period"], "t"),
    }
    return {"period": [{"period": period}], **{k: [r.asDict() for r in f.collect()] for k, f in frames.items()}}


def headline(alert: dict) -> str:
    """[G-6]"""
    way = "above" if (alert["deviation_pct"] or 0) >= 0 else "below"
    return f"{alert['entity_key']} {alert['direction'].lower()} freight {abs(alert['deviation_pct'] or 0):.1f}% {way} expectation in {alert['period']}"


def bars(rows: list[dict], label: str, value: str, width: int = 320) -> str:
    """[P-20] Bars scaled to the largest."""
    peak = max((r[value] or 0 for r in rows), default=0) or 1
    parts = [f'<text x="0" y="{18 * i + 13}">{escape(clip(str(r[label])))}</text><rect x="190" y="{18 * i + 3}" height="12" width="{width * (r[value] or 0) / peak:.1f}"/>' for i, r in enumerate(rows)]
    return f'<svg width="{width + 200}" height="{18 * len(rows) + 6}">{"".join(parts)}</svg>'


def markdown(brief: dict[str, list[dict]]) -> str:
    lines = [f"# Freight brief {brief['period'][0]['period']}", "", "| direction | MT |", "|-|-|", *[f"| {r['direction']} | {r['mt']:,.1f} |" for r in brief["totals"]], "", "## Top", ""]
    lines += [f"{i}. {r['airport_name']} {r['mt']:,.1f} MT ({signed_pct(r['growth_pct'])})" for i, r in enumerate(brief["top"], 1)]
    return "\n".join([*lines, "", "## Alerts", "", *[f"- {headline(a)}" for a in brief["alerts"]], ""])


def html(brief: dict[str, list[dict]]) -> str:
    rows = "".join(f"<tr><td>{escape(r['airport_name'])}</td><td>{r['mt']:,.1f}</td><td>{signed_pct(r['growth_pct'])}</td></tr>" for r in brief["top"])
    return f"<h1>Freight brief {escape(brief['period'][0]['period'])}</h1>{bars(brief['top'], 'airport_name', 'mt')}<table>{rows}</table><ul>{''.join(f'<li>{escape(headline(a))}</li>' for a in brief['alerts'])}</ul>"


def prometheus(facts: DataFrame) -> str:
    """[A-14] Gauges as text."""
    r = facts.agg(F.count("*").alias("facts"), F.countDistinct("airport_iata").alias("airports"), F.countDistinct("period").alias("periods")).head()
    return "".join(f"# TYPE tidemark_{k} gauge\ntidemark_{k} {v}\n" for k, v in r.asDict().items())
