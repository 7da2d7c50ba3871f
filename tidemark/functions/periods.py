"""Period labels: ``YYYY-MM``, ``YYYY-FY`` (fiscal year from April) and ``YYYY-A``.

All functions are column expressions. Ids in brackets are SURVEY section 2 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = r"^(\d{4})-(0[1-9]|1[0-2])$"

#: Month names by number.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def kind(period: Column) -> Column:
    """[N-12] MONTH, FISCAL or ANNUAL; what can't be read counts as ANNUAL."""
    return F.when(period.rlike(MONTH), "MONTH").when(period.rlike(r"^\d{4}-FY$"), "FISCAL").otherwise("ANNUAL")


def year(period: Column) -> Column:
    """[N-12] The calendar (or first fiscal) year; 1900 where there is none."""
    return F.when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2]|FY|A)$"), _int(F.substring(period, 1, 4))).otherwise(1900)


def month(period: Column) -> Column:
    return F.when(period.rlike(MONTH), _int(F.substring(period, 6, 2)))


def fiscal_start(period: Column) -> Column:
    """[N-12] The year in which the label's fiscal year starts; null for ANNUAL."""
    k = kind(period)
    return F.when(k == "MONTH", year(period) - F.when(month(period) < 4, 1).otherwise(0)).when(k == "FISCAL", year(period))


def sort_key(period: Column) -> Column:
    """[N-12] One order for all kinds: year, then month, 6 (FY) or 12 (A)."""
    k = kind(period)
    key = year(period) * 100 + F.when(k == "MONTH", month(period)).when(k == "FISCAL", 6).otherwise(12)
    return F.when(year(period) == 1900, 0).otherwise(key)


def next_label(period: Column, step: Column | int) -> Column:
    """[W-24] The label ``step`` periods later, of the same kind."""
    step = F.lit(step) if isinstance(step, int) else step
    months = year(period) * 12 + month(period) - 1 + step
    moved = F.format_string("%04d-%02d", F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"))
    tail = F.substring(period, 5, 3)
    return F.when(kind(period) == "MONTH", moved).otherwise(F.concat((year(period) + step).cast("string"), tail))


def prior_label(period: Column) -> Column:
    """[J-16] The same label one year earlier."""
    return F.concat((year(period) - 1).cast("string"), F.substring(period, 5, 3))


def _month_number(name: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.trim(name), 1, 3)))
    return F.nullif(place, F.lit(0)).cast("int")


def month_to_iso(name: Column, year_: Column) -> Column:
    """[N-4] 'April', 2026 to '2026-04'; null for what is no month."""
    n = _month_number(name)
    return F.when(n.isNotNull() & year_.isNotNull(), F.format_string("%04d-%02d", year_, n))


def fiscal_months(label: Column) -> tuple[Column, Column]:
    """[N-5] '2026-2027' to ('2026-04', '2027-03'); nulls otherwise."""
    start = F.nullif(F.regexp_extract(F.trim(label), r"^(\d{4})\s*[-/]\s*\d{2,4}", 1), F.lit(""))
    return F.concat(start, F.lit("-04")), F.concat((_int(start) + 1).cast("string"), F.lit("-03"))


def header_year(cell: Column) -> Column:
    """[N-13] The year that a header cell ('2015-16' or '2015') sets for the
    month rows below it."""
    span = F.regexp_extract(F.trim(cell), r"^((?:19|20)\d{2})\s*[-/]\s*\d{2,4}$", 1)
    alone = F.regexp_extract(F.trim(cell), r"^((?:19|20)\d{2})$", 1)
    return _int(F.coalesce(F.nullif(span, F.lit("")), F.nullif(alone, F.lit(""))))


def row_period(cell: Column, carried_year: Column) -> Column:
    """[N-13] The label of a row's period cell. A cell that opens with a month
    takes the carried year, January to March the one after, and has none without; '2007-08' is a fiscal year if the tail
    is the next year's, else a month if it can be one."""
    raw = F.trim(cell)
    n = _month_number(raw)
    bare = F.when(carried_year.isNotNull(), F.format_string("%d-%02d", carried_year + F.when(n < 4, 1).otherwise(0), n))
    dash = r"^(\d{4})[-/](\d{1,2})$"
    y, tail = _int(F.regexp_extract(raw, dash, 1)), _int(F.regexp_extract(raw, dash, 2))
    dashed = F.when(tail == (y + 1) % 100, F.format_string("%d-FY", y)).when(tail.between(1, 12), F.format_string("%d-%02d", y, tail)).otherwise(F.format_string("%d-A", y))
    any_year = F.nullif(F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    fallback = F.when(any_year.isNotNull(), F.concat(any_year, F.lit("-A")))
    return F.when(n.isNotNull(), bare).when(raw.rlike(dash), dashed).otherwise(fallback)


def header_period(text: Column) -> Column:
    """[S-6] The reporting month of a header block: its first month name and first
    year that stands alone; where two scripts are interleaved, the month after
    the other script and all blanks are taken out."""
    head = F.substring(text, 1, 1600)
    months = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
    year_ = F.nullif(F.regexp_extract(head, r"(?<![\d-])(20\d{2})(?![\d-])", 1), F.lit(""))
    whole = F.regexp_extract(head, rf"(?i)\b{months}\b", 1)
    compact = F.regexp_extract(F.regexp_replace(F.regexp_replace(head, r"\p{InDevanagari}", ""), r"\s+", ""), f"(?i){months}", 1)
    return month_to_iso(F.coalesce(F.nullif(whole, F.lit("")), F.nullif(compact, F.lit(""))), _int(year_))


def filename_period(url: Column) -> Column:
    """[S-20] 'April2k26Annex4.pdf' and 'Apr2026.pdf' to '2026-04': a hint only."""
    name = F.regexp_extract(url, r"([^/]*)$", 1)
    found = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*2?k?(\d{2,4})"
    y = F.regexp_extract(name, found, 2)
    return month_to_iso(F.regexp_extract(name, found, 1), F.when(F.length(y) == 4, _int(y)).otherwise(2000 + _int(y)))


def title_year(title: Column) -> Column:
    """[N-19] The first year in a title, as an annual label."""
    found = F.nullif(F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    return F.concat(found, F.lit("-A"))
