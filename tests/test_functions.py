"""Scalar expressions against literal cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cells, periods


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_period_attributes(spark):
    c = F.col("p")
    got = values(spark, [("2023-06",), ("2023-FY",), ("2023-A",), ("unknown",), ("2024-02",)], "p string", periods.kind(c), periods.year(c), periods.sort_key(c), periods.fiscal_start(c))
    assert got == [("MONTH", 2023, 202306, 2023), ("FISCAL", 2023, 202306, 2023), ("ANNUAL", 2023, 202312, None), ("ANNUAL", 1900, 0, None), ("MONTH", 2024, 202402, 2023)]


def test_next_label(spark):
    got = values(spark, [("2023-11", 3), ("2023-FY", 1), ("2023-A", 2)], "p string, n int", periods.next_label(F.col("p"), F.col("n")))
    assert [g[0] for g in got] == ["2024-02", "2024-FY", "2025-A"]


def test_row_period(spark):
    rows = [("APR", 2015), ("JAN", 2015), ("MAY", None), ("2007-08", None), ("2007-11", None), ("2007-13", None), ("April 2026", None), ("in 1999", None), ("x", None)]
    got = values(spark, rows, "c string, y int", periods.row_period(F.col("c"), F.col("y")))
    assert [g[0] for g in got] == ["2015-04", "2016-01", None, "2007-FY", "2007-11", "2007-A", None, "1999-A", None]


def test_header_year(spark):
    got = values(spark, [("2015-16",), ("2015",), ("APR",)], "c string", periods.header_year(F.col("c")))
    assert [g[0] for g in got] == [2015, 2015, None]


def test_numbers_and_units(spark):
    got = values(spark, [("1,234.5",), ("-",), ("N/A",), ("12 %",), (None,), ("x",)], "c string", cells.number(F.col("c")))
    assert [g[0] for g in got] == [1234.5, None, None, 12.0, None, None]
    assert values(spark, [(2.0, " Tonnes.")], "v double, u string", cells.kilograms(F.col("v"), F.col("u"))) == [(2000.0,)]
    with pytest.raises(Exception, match="unknown mass unit"):
        values(spark, [(2.0, "stone")], "v double, u string", cells.kilograms(F.col("v"), F.col("u")))


def test_names(spark):
    rows = [("अमृतसर AMRITSAR",), ("(दिल्ली) DELHI",), ("HYDERABAD(BEGUMPET)",), ("ADAMPUR (JALANDH",), ("Goa International Airport",)]
    got = [g[0] for g in values(spark, rows, "c string", cells.name_variants(F.col("c")))]
    assert got[0] == ["AMRITSAR"] and got[1] == ["DELHI"]
    assert got[2] == ["HYDERABAD (BEGUMPET)", "HYDERABAD", "BEGUMPET"]
    assert got[3] == ["ADAMPUR (JALANDH", "ADAMPUR"] and got[4][-1] == "GOA"


def test_titles(spark):
    t = [("Statistics on Domestic Services of Air Costa from 2007-08",), ("Traffic (International+Domestic) by Blue Dart during 2010",), ("Growth of traffic statistics from 2011",), ("nothing",)]
    got = values(spark, t, "t string", cells.direction(F.col("t")), cells.carrier(F.col("t")), periods.title_year(F.col("t")))
    assert got == [("DOMESTIC", "Air Costa", "2007-A"), ("TOTAL", "Blue Dart", "2010-A"), ("TOTAL", None, "2011-A"), ("TOTAL", None, None)]


def test_media_and_secrets(spark):
    rows = [("%PDF-1.4", None), ("{bad", "text/csv; x"), ('{"a": 1}', None), ("<!DOCTYPE html>", None), ("zz", None)]
    got = [g[0] for g in values(spark, rows, "p string, d string", cells.media_type(F.col("p"), F.col("d")))]
    assert got == ["application/pdf", "text/csv", "application/json", "text/html", "application/octet-stream"]
    assert values(spark, [("http://x?api-key=s&y=1",)], "u string", cells.redacted(F.col("u"))) == [("http://x?api-key=<redacted>&y=1",)]


def test_grounding(spark):
    rows = [("In 2026-04 Delhi moved 1,234.6 MT", [1234.56], 1), ("moved 9,999.9 MT", [1.0], 1), ("the top 5 of 2024", [1.0], 1), ("moved 77,777", [], 0)]
    got = values(spark, rows, "t string, v array<double>, n int", cells.grounded(F.col("t"), F.col("v"), F.col("n")))
    assert [g[0] for g in got] == [True, False, True, True]
