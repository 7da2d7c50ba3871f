"""Cells, names, titles and links of published tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilograms of a mass unit by its spelling.
UNIT_KG = {
    "kg": 1.0,
    "kgs": 1.0,
    "kilogram": 1.0,
    "mt": 1000.0,
    "tonne": 1000.0,
    "tonnes": 1000.0,
    "t": 1000.0,
    "ton": 1000.0,
    "metric tonne": 1000.0,
}
#: Cells that mean "no value".
NULLS = ("", "-", "--", "NA", "N/A", "nil", "Nil")
#: URL parameters whose values are secrets.
SECRETS = ("api-key", "api_key", "apikey", "key", "token", "access_token")
#: Words of a dataset about cargo, and about aviation.
CARGO_TERMS = ("cargo", "freight", "tonnage", "tonne", "goods", "exim", "export", "import", "consignment")
AVIATION_TERMS = ("aviation", "airport", "airline", "aircraft", "air ", "flight", "dgca", "aai", "civil aviation")
#: Tokens that carry no meaning in retrieval.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "was", "are", "were",
    "has", "have", "had", "not", "but", "all", "any", "its", "per", "than",
    "into", "over", "under", "each", "such", "which", "been", "will", "would",
)


def kilograms(value: Column, unit: Column) -> Column:
    """[N-1] Mass in kg; an unknown unit is an error."""
    key = F.regexp_replace(F.lower(F.trim(unit)), r"\.+$", "")
    factor = F.coalesce(*[F.when(key == u, F.lit(k)) for u, k in UNIT_KG.items()])
    return F.when(factor.isNotNull(), value * factor).otherwise(F.raise_error(F.concat(F.lit("unknown mass unit: "), unit)).cast("double"))


def number(cell: Column) -> Column:
    """[N-2, N-3] The first number of a cell, thousands separators ignored."""
    text = F.regexp_replace(F.trim(cell), r"[\n ]", "")
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d*\.?\d+", 0)
    return F.when(~text.isin(*NULLS), found.try_cast("double"))


def latin_name(cell: Column) -> Column:
    """[N-6] A bilingual cell without its Devanagari, emptied brackets and stray marks."""
    kept = F.regexp_replace(cell, r"\p{InDevanagari}", "")
    kept = F.regexp_replace(F.regexp_replace(kept, r"\(\s*\)", " "), r"[^\w\s()/&.-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def name_variants(cell: Column) -> Column:
    """[N-7] Spellings to try, most specific first: the whole, the part before an
    unclosed bracket, outer and inner part, the whole without common words."""
    base = F.regexp_replace(F.regexp_replace(F.upper(latin_name(cell)), r"\s*\(\s*", " ("), r"\s*\)", ")")
    base = F.trim(base)
    unclosed = F.regexp_count(base, F.lit(r"\(")) > F.regexp_count(base, F.lit(r"\)"))
    both = r"^(.*?)\s*\(([^)]*)\)\s*$"
    outer, inner = F.trim(F.regexp_extract(base, both, 1)), F.trim(F.regexp_extract(base, both, 2))
    plain = F.trim(F.regexp_replace(F.regexp_replace(base, r"\b(AIRPORT|INTERNATIONAL|INTL|CIVIL|ENCLAVE)\b", ""), r"\s+", " "))
    tried = F.array(base, F.when(unclosed, F.trim(F.substring_index(base, "(", 1))), outer, inner, plain)
    return F.array_distinct(F.filter(tried, lambda v: v.isNotNull() & (v != "")))


def redacted(text: Column) -> Column:
    """[N-11] Secrets in URL parameters masked."""
    return F.regexp_replace(text, r"(?i)([?&](?:" + "|".join(SECRETS) + r")=)([^&\s]+)", "$1<redacted>")


def unit_of(column: Column) -> Column:
    """[N-15] The unit that a column's name gives; MT if none."""
    name = F.regexp_replace(F.lower(column), r"[_\-]+", " ")
    return F.when(name.rlike(r"\bkgs?\b|kilogram"), "kg").otherwise("MT")


def direction(title: Column) -> Column:
    """[N-18] Combined phrases count before single words."""
    low = F.lower(title)
    combined = low.rlike(r"international\s*[+&/]\s*domestic|domestic\s*[+&/]\s*international|int'?l\s*[+&/]\s*dom|\btotal\b")
    return F.when(combined, "TOTAL").when(low.contains("international"), "INTERNATIONAL").when(low.contains("domestic"), "DOMESTIC").otherwise("TOTAL")


def carrier(title: Column) -> Column:
    """[N-20] The carrier a title names last; null where it is a clause."""
    found = F.regexp_extract(title, r"(?i).*\b(?:of|by)\s+(.+?)\s+(?:from|during|for|on|in)\b", 1)
    name = F.regexp_replace(F.regexp_replace(found, r"\s+", " "), r"^[ ,.-]+|[ ,.-]+$", "")
    clause = r"(?i)\b(statistic|traffic|service|coefficient|aircraft|fleet|strength|utilisation|utilization|growth|percentage|productivity|operating)\b"
    fine = (name != "") & (F.length(name) <= 48) & (F.size(F.split(name, " ")) <= 5) & ~name.rlike(clause)
    return F.when(fine, name)


def is_aggregate(name: Column) -> Column:
    """[N-21] A name that stands for a whole industry."""
    return name.rlike(r"(?i)^(all\s|total\b|private carriers\b|scheduled (?:domestic|foreign) )")


def measure_slug(title: Column, column: Column) -> Column:
    """[N-22] A stable short name without years and filler words."""
    base = F.regexp_replace(title, r"\b(19|20)\d{2}(-\d{2,4})?\b", "")
    base = F.regexp_replace(base, r"(?i)\b(from|to|during|of|the|on|and|for|details|statistics)\b", " ")

    def slug(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")

    base = F.coalesce(F.nullif(slug(base), F.lit("")), slug(column))
    return F.coalesce(F.nullif(F.substring(base, 1, 60), F.lit("")), F.lit("measure"))


def relevance(text: Column) -> Column:
    """[N-23] The cargo and aviation terms found, if both kinds are; else empty."""
    low = F.lower(text)
    cargo, air = (F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)) for terms in (CARGO_TERMS, AVIATION_TERMS))
    return F.when((F.size(cargo) > 0) & (F.size(air) > 0), F.concat(cargo, air)).otherwise(F.array().cast("array<string>"))


def media_type(payload: Column, declared: Column) -> Column:
    """[S-12] Type by the first bytes: PDF, zip, JSON that parses, HTML markers,
    then what was declared."""
    head = F.substring(payload, 1, 2048)
    json = F.substring(payload, 1, 1).isin("{", "[") & F.try_parse_json(payload).isNotNull()
    html = F.lower(head).rlike("<html|<!doctype html|<head|<body")
    said = F.nullif(F.trim(F.substring_index(declared, ";", 1)), F.lit(""))
    return F.when(head.startswith("%PDF-"), "application/pdf").when(head.startswith("PK\x03\x04"), "application/zip").when(json, "application/json").when(html, "text/html").otherwise(F.coalesce(said, F.lit("application/octet-stream")))


def type_mismatch(url: Column, sniffed: Column) -> Column:
    """[S-13] The URL's extension promises another type than was found."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.(pdf|xlsx|xls|csv|json|html?)$", 1))
    due = F.when(suffix == "pdf", "application/pdf").when(suffix == "xlsx", "application/zip").when(suffix == "json", "application/json").when(suffix.isin("html", "htm"), "text/html")
    return F.coalesce(due != sniffed, F.lit(False))


def tokens(text: Column) -> Column:
    """[R-6] Lower-case runs of letters and digits of over two characters that
    are neither stop words nor figures."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS) & ~t.rlike(r"^\d+$"))


def figures(text: Column) -> Column:
    """[G-4] The figures of a sentence, period labels left out."""
    plain = F.regexp_replace(text, r"\b\d{4}-(?:\d{2}|FY|A)\b", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(-?\d[\d,]*\.?\d*)"), 1)
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, ",", "").try_cast("double")), lambda v: v.isNotNull())


def grounded(text: Column, values: Column, rows: Column) -> Column:
    """[G-4, G-5] Every figure of ``text`` is one of ``values`` at 0 or 1 decimals;
    small whole numbers (counts, years) are exempt; without rows all passes."""
    most = F.greatest(F.lit(2100), rows * 10)
    shown = F.flatten(F.transform(values, lambda v: F.array(F.format_string("%.1f", v), F.format_string("%.0f", v))))

    def fine(n: Column) -> Column:
        whole = (n == F.floor(n)) & n.between(F.lit(0), most)
        return whole | F.array_contains(shown, F.format_string("%.1f", n)) | F.array_contains(shown, F.format_string("%.0f", n))

    return (rows == 0) | F.forall(figures(text), fine)
