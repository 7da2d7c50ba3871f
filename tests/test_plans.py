"""The semantic layer, structure, warehouse, retrieval and streaming."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval, structure, warehouse
from tidemark.plans import ORACLE_SQL, QUERIES, brief, proxy
from tidemark.plans.semantic import QueryRejected, QuerySpec, citations, compile_query, describe
from tidemark.sources import readers, records
from tidemark.streaming.upserts import Versioned, run

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    return proxy.facts(spark, SF).cache()


@pytest.mark.parametrize("spec", [
    QuerySpec(["nope"]),
    QuerySpec(["tonnage_mt"], ["airline_name"]),
    QuerySpec(["tonnage_mt"], ["airport_name; DROP TABLE x"]),
    QuerySpec(["tonnage_mt"], filters={"secret": 1}),
    QuerySpec(["tonnage_mt"], filters={"calendar_year": "x"}),
    QuerySpec(["tonnage_mt"], order_by="growth_yoy_pct"),
    QuerySpec(["tonnage_mt"], ["airport_city"]),
    QuerySpec([]),
])
def test_rejected(facts, spec):
    with pytest.raises(QueryRejected):
        compile_query(spec, facts)


def test_compiled(facts):
    spec = QuerySpec(["tonnage_mt", "growth_yoy_pct"], ["airport_iata"], {"direction": "TOTAL", "period": "2001-07"}, "growth_yoy_pct", False, 10_000)
    got = [r["growth_yoy_pct"] for r in compile_query(spec, facts).collect()]
    known = [g for g in got if g is not None]
    assert known == sorted(known) and got[: len(known)] == known
    told = {r["kind"]: r["count"] for r in describe(facts.sparkSession).groupBy("kind").count().collect()}
    assert "growth_yoy_pct" in spec.explain() and told == {"metric": 6, "dimension": 11, "filter": 12}
    docs = facts.select("source_document_id").distinct()
    assert citations(facts, docs, {"grain": "AIRPORT"}).count() == 12


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_schema(spark, name):
    """The columns of a query are those of its SQL twin (values: the driver's run)."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = [r[0] for r in con.execute(f"DESCRIBE ({ORACLE_SQL[name]})").fetchall()]
    assert sorted(QUERIES[name](spark, SF).columns) == sorted(want)


def test_attribution_adds_up(spark):
    now, then = (spark.createDataFrame(r, "entity_key string, mt double") for r in ([("a", 10.0), ("b", 30.0)], [("a", 20.0), ("c", 20.0)]))
    got = structure.attribution(now, then, 99).collect()
    assert sum(r["contribution_pp"] for r in got) == pytest.approx(100 * (40 - 40) / 40) and sum(r["share_of_change_pct"] for r in got) == pytest.approx(100)


def test_concentration(spark):
    df = spark.createDataFrame([("p", 5.0)] * 4 + [("p", 0.0)], "g string, v double")
    r = structure.concentration(df, ["g"], "v").head()
    assert (r["hhi"], r["effective_n"], r["interpretation"]) == (2500, 4.0, "highly concentrated")


def test_pearson_refuses(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    assert df.agg(structure.pearson(F.col("x"), F.col("y"))).head()[0] is None
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "x double, y double")
    assert flat.agg(structure.pearson(F.col("x"), F.col("y"))).head()[0] is None


def test_upsert_null_keys(spark):
    schema = "k string, a int, b int"
    old, new = spark.createDataFrame([(None, 1, 1), ("x", 2, 2)], schema), spark.createDataFrame([(None, 9, 9), ("y", 3, 3)], schema)
    assert {tuple(r) for r in warehouse.upsert(old, new, ["k"], ["a"]).collect()} == {(None, 9, 1), ("x", 2, 2), ("y", 3, 3)}
    kept, gone = warehouse.retire(old, new, ["k"])
    assert [r["k"] for r in kept.collect()] == [None] and [r["k"] for r in gone.collect()] == ["x"]


def airports(spark, rows):
    return spark.createDataFrame([(*r, True, i) for i, r in enumerate(rows)], "name string, iata string, icao string, country string, is_international boolean, file_order int")


def test_fuzzy_in_the_country(spark):
    names = spark.createDataFrame([("b", "IN", "XANGALORE FIELD"), ("z", "IN", "ZZZ"), ("n", None, "BANGALORE FIELDS"), ("f", "FR", "BANGALORE FIELDS")], "raw string, country string, name string")
    air = airports(spark, [("BANGALORE FIELD", "BLR", "VOBL", "IN"), ("XANGALORE FIELDS", "XXX", "X", "US")])
    got = {r["raw"]: r["iata"] for r in warehouse.fuzzy(names, air).collect()}
    assert got == {"b": "BLR", "n": "BLR", "f": "BLR"}  # a country without airports is no bar


def test_cascade(spark):
    air = airports(spark, [("GOA", "GOI", "VOGO", "India"), ("GENOA", "GOA", "LIMJ", "Italy"), ("KOCHI", "COK", "VOCI", "India")])
    facts = spark.createDataFrame([
        ("AIRLINE", None, None, None, None), ("AIRPORT", "DEL", None, "x", "India"), ("AIRPORT", None, " vogo ", "x", "Italy"),
        ("AIRPORT", None, None, "Goa", "India"), ("AIRPORT", None, None, "GOA", "Italy"), ("AIRPORT", None, None, "cok", "India"),
        ("AIRPORT", None, None, "cok", "Italy"), ("AIRPORT", None, None, "", "India"), ("AIRPORT", None, None, None, None), ("AIRPORT", None, "????", "Goa", None),
    ], "grain string, airport_iata string, airport_icao string, airport_name_raw string, country string")
    rows = warehouse.reconciled(facts.withColumn("i", F.monotonically_increasing_id()).coalesce(1), air).orderBy("i").collect()
    got = [(r["airport_iata"], r["resolution_confidence"], r["resolution_method"]) for r in rows]
    assert got == [
        (None, 1.0, "airline-grain"), ("DEL", 1.0, "pre-resolved"), ("GOI", 1.0, "icao"), ("GOI", 1.0, "exact-name"), (None, 0.75, "exact-name-country-mismatch"),
        ("COK", 1.0, "iata"), (None, 0.0, "unresolved"), (None, 0.0, "empty"), (None, 0.0, "empty"), (None, 1.0, "icao"),
    ]


def test_records(spark):
    import json

    def payload(title, rows, **more):
        return json.dumps({"index_name": "x", "title": title, "records": rows} | more)

    months = [{"year_month": "2015-16", "cargo": "9"}, {"year_month": "APR", "cargo": "1,000"}, {"year_month": "JAN", "cargo": "2"}, {"year_month": "MAY", "cargo": "NA"}]
    cases = [
        payload("Cargo", [{"Airport_Name": "Goa", "Freight_Tonnes": "12", "Year": "2023"}, {"Airport_Name": " ", "Freight_Tonnes": "1", "Year": "2023"}]),
        payload("Cargo", [{"airport": "Goa", "cargo_kg": "12", "year": "2023"}]),
        payload("Details of Annual Traffic on Domestic Services of Air Costa from 2007-08", [{"_year": "2007-08", "ton_kms_performed_million___freight": "1", "cargo_carried_ton___total": "5"}]),
        payload("Cargo by Red Air during 2015", months),
        payload("Growth of Red Air in 2015", [{"year": "2015", "percentage growth in cargo": "5"}]),
        payload("Cargo", [{"year": "2015", "cargo": "5"}]),
        payload("Cargo", []), "{", None,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, payload string")
    got = [(r["source_document_id"], r["grain"], r["airport_name_raw"], r["airline"], r["period"], r["direction"], r["tonnage_kg"]) for r in records.parsed(df).orderBy("source_document_id", "rec_no").collect()]
    assert got == [
        (0, "AIRPORT", "Goa", None, "2023-A", "TOTAL", 12000.0), (1, "AIRPORT", "Goa", None, "2023-A", "TOTAL", 12.0), (2, "AIRLINE", None, "Air Costa", "2007-FY", "DOMESTIC", 5000.0),
        (3, "AIRLINE", None, "Red Air", "2015-FY", "TOTAL", 9000.0), (3, "AIRLINE", None, "Red Air", "2015-04", "TOTAL", 1000000.0), (3, "AIRLINE", None, "Red Air", "2016-01", "TOTAL", 2000.0),
    ]
    assert [r["reason"] for r in records.mapped(df).orderBy("doc_id").collect()][4:] == ["no mass column", "no carrier", "no records", "no records", "no records"]


@pytest.mark.parametrize("name", ["rankings_tonnage", "fact_star_view", "local_robust_z", "concentration_hhi", "carrier_efficiency_pivot", "statistical_anomalies", "brief_movers"])
def test_line_items_are_scanned_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_suppkey" in line and "Relation" in line for line in plan.splitlines()) <= 1


def test_a_month_reaches_the_scan(spark):
    plan = QUERIES["rankings_tonnage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "o_orderdate" in line and "PushedFilters" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan


def test_chunks_against_loop(spark):
    import random

    rng = random.Random(3)
    texts = ["\n\n".join("w" * rng.randint(1, 60) + " " + "x" * rng.choice([10, 300, 3000]) for _ in range(rng.randint(0, 12))) for _ in range(30)] + ["", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in retrieval.chunks(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    for i, text in enumerate(texts):
        out, buf = [], ""
        for p in [q.strip() for q in text.split("\n\n") if q.strip()]:
            if len(buf) + len(p) + 2 <= 1280:
                buf = buf + "\n\n" + p if buf else p
                continue
            if buf:
                out.append(buf)
                buf = buf[-192:] + "\n\n" + p
            else:
                buf = p
            while len(buf) > 1280 * 1.6:
                out.append(buf[:1280])
                buf = buf[1280 - 192 :]
        if buf.strip():
            out.append(buf)
        assert got.get(i, []) == [c for c in out if len(c) >= 40]


def test_embedding_and_readers(spark, tmp_path):
    from hashlib import blake2b
    from math import log, sqrt

    said = {0: "delhi freight delhi 123 the", 1: "cargo", 2: "the 12"}
    vocab = spark.createDataFrame([("delhi", 2.0), ("cargo", 3.0)], "token string, idf double")
    h = lambda t: int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big")
    want = {}
    for i, bag in {0: {"delhi": (2, 2.0), "freight": (1, retrieval.MAX_IDF)}, 1: {"cargo": (1, 3.0)}}.items():
        v = {}
        for w, (tf, idf) in bag.items():
            v[h(w) % 1024] = v.get(h(w) % 1024, 0) + (1 if h("sign" + w) % 2 else -1) * (1 + log(tf)) * idf
        norm = sqrt(sum(x * x for x in v.values()))
        want |= {(i, k): pytest.approx(x / norm) for k, x in v.items()}
    df = spark.createDataFrame(list(said.items()), "doc_id int, text string")
    assert {(r["doc_id"], r["place"]): r["x"] for r in retrieval.hashed_vectors(df, vocab).collect()} == want
    (tmp_path / "ledger.jsonl").write_text('{"doc_id": "a", "status": "old"}\n{"doc_id": "a", "status": "new"}\n')
    assert [r["status"] for r in readers.ledger(spark, str(tmp_path / "ledger.jsonl")).collect()] == ["new"]
    (tmp_path / "bulk.csv").write_text('1,"Goa",Goa,India,GOI,VOGO,1,2,3,4,U,Asia\n2,"X",Y,India,\\N,\\N,1,2,3,4,U,Asia\n3,short\n')
    (tmp_path / "alias.csv").write_text("alias,iata,icao,airport_name,city,country,confidence,note\nDABOLIM,GOI,VOGO,Goa,Goa,India,1.0,\n")
    got = readers.crosswalk(spark, str(tmp_path / "bulk.csv"), str(tmp_path / "alias.csv")).orderBy("precedence", "name").collect()
    assert [(r["name"], r["iata"]) for r in got] == [("DABOLIM", "GOI"), ("GOA", "GOI"), ("X", None)]


def test_brief(facts):
    b = brief.build(facts.where("period < '2001-08'"), "2001-07")
    assert len(b["top"]) <= 10 and "2001-07" in brief.markdown(b) and "<svg" in brief.html(b) and "tidemark_facts" in brief.prometheus(facts)


def test_streamed_upserts(spark, tmp_path):
    schema = "k string, v int, at int"
    table = Versioned(spark, f"file://{tmp_path}/t", schema)
    for rows in ([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], [("a", 3, 3), ("c", 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, f"{tmp_path}/in", table, ["k"], ["v", "at"], ["at"], f"{tmp_path}/cp").awaitTermination()
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", 3), ("b", 1), ("c", 1)}
