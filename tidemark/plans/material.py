"""Registered queries: normalisation, sources, traces, retrieval and grounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cells, periods
from tidemark.operators import retrieval, traces, warehouse
from tidemark.plans.proxy import table
from tidemark.plans.registry import query
from tidemark.sources import readers

_UNITS = "['kg', 'Kgs', 'kilogram.', 'MT', 'tonne', 'tonnes', 't', 'ton', 'metric tonne']"


@query("unit_normalisation", f"""SELECT p_partkey, CASE WHEN lower(rtrim({_UNITS}[p_partkey % 9 + 1], '.')) IN ('kg', 'kgs', 'kilogram') THEN 1.0 ELSE 1000.0 END * p_size AS kg,
  CASE p_partkey % 4 WHEN 0 THEN 1234.5 + p_size WHEN 1 THEN NULL WHEN 2 THEN -1.0 * p_size ELSE p_size + 0.5 END AS cell_value FROM part""")
def unit_normalisation(spark, d):
    """[N-1 to N-3]"""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    unit = F.get(F.array(*map(F.lit, ["kg", "Kgs", "kilogram.", "MT", "tonne", "tonnes", "t", "ton", "metric tonne"])), (F.col("p_partkey") % 9).cast("int"))
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    cell = F.when(k == 0, F.concat(F.lit(" 1,"), (234 + F.col("p_size")).cast("string"), F.lit(".5 "))).when(k == 1, "N/A").when(k == 2, F.concat(F.lit("-"), size, F.lit(" MT"))).otherwise(F.concat(size, F.lit(".5%")))
    return p.select("p_partkey", cells.kilograms(F.col("p_size").cast("double"), unit).alias("kg"), cells.number(cell).alias("cell_value"))


@query("month_and_fiscal_labels", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS iso, CAST(year(o_orderdate) AS VARCHAR) || '-04' AS fy_from, CAST(year(o_orderdate) + 1 AS VARCHAR) || '-03' AS fy_to FROM orders""")
def month_and_fiscal_labels(spark, d):
    """[N-4, N-5]"""
    o = table(spark, d, "orders")
    y = F.year("o_orderdate")
    a, b = periods.fiscal_months(F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string")))
    return o.select("o_orderkey", periods.month_to_iso(F.date_format("o_orderdate", "MMMM"), y).alias("iso"), a.alias("fy_from"), b.alias("fy_to"))


@query("row_periods", """WITH c AS (SELECT c_custkey AS id, 1990 + c_custkey % 30 AS y, c_custkey // 13 AS g, c_custkey % 13 AS k FROM customer), h AS (SELECT *, first_value(y) OVER (PARTITION BY g ORDER BY k) AS y0, min(k) OVER (PARTITION BY g) AS k0 FROM c)
  SELECT id, CASE WHEN k = 0 THEN CAST(y AS VARCHAR) || '-FY' WHEN k0 > 0 THEN NULL ELSE CAST(y0 + CASE WHEN (k + 2) % 12 + 1 < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((k + 2) % 12 + 1 AS VARCHAR), 2, '0') END AS period FROM h""")
def row_periods(spark, d):
    """[N-13] Fiscal header rows above bare months, the header carried down."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (1990 + F.col("c_custkey") % 30).alias("y"), F.floor(F.col("c_custkey") / 13).alias("g"), (F.col("c_custkey") % 13).alias("k"))
    head = F.concat(F.col("y").cast("string"), F.lit("-"), F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0"))
    month = F.upper(F.get(F.array(*map(F.lit, periods.MONTHS)), ((F.col("k") + 2) % 12).cast("int")))
    c = c.withColumn("cell", F.when(F.col("k") == 0, head).otherwise(month))
    carried = F.last(periods.header_year(F.col("cell")), ignorenulls=True).over(Window.partitionBy("g").orderBy("k"))
    return c.withColumn("carried", carried).select("id", periods.row_period(F.col("cell"), F.col("carried")).alias("period"))


_TITLE = """t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'International' WHEN 1 THEN 'Domestic' ELSE 'International + Domestic' END AS dirn, 'Air ' || p_brand AS name FROM part)"""


@query("title_parsing", f"""WITH {_TITLE} SELECT id, CASE dirn WHEN 'International' THEN 'INTERNATIONAL' WHEN 'Domestic' THEN 'DOMESTIC' ELSE 'TOTAL' END AS direction, name AS carrier, '2007-A' AS period, 'annual-cargo-' || trim(regexp_replace(lower(dirn), '[^a-z]+', '-', 'g'), '-') || '-services-air-' || trim(regexp_replace(lower(substr(name, 5)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, FALSE AS aggregate_, 'MT' AS unit FROM t""")
def title_parsing(spark, d):
    """[N-15, N-18 to N-22]"""
    k = F.col("p_partkey") % 3
    dirn = F.when(k == 0, "International").when(k == 1, "Domestic").otherwise("International + Domestic")
    title = F.concat(F.lit("Details of Annual Cargo on "), dirn, F.lit(" Services of Air "), F.col("p_brand"), F.lit(" from 2007-08 to 2015-16"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("t"))
    c = F.col("t")
    carrier = cells.carrier(c)
    return t.select("id", cells.direction(c).alias("direction"), carrier.alias("carrier"), periods.title_year(c).alias("period"), cells.measure_slug(c, F.lit("x")).alias("slug"), cells.is_aggregate(carrier).alias("aggregate_"), cells.unit_of(F.lit("cargo_mt")).alias("unit"))


@query("dataset_relevance", "SELECT doc_id, (contains(lower(text), 'cargo') OR contains(lower(text), 'export') OR contains(lower(text), 'import') OR contains(lower(text), 'freight') OR contains(lower(text), 'tonnage') OR contains(lower(text), 'tonne') OR contains(lower(text), 'goods') OR contains(lower(text), 'exim') OR contains(lower(text), 'consignment')) AND (contains(lower(text), 'air ') OR contains(lower(text), 'aai') OR contains(lower(text), 'aviation') OR contains(lower(text), 'airport') OR contains(lower(text), 'airline') OR contains(lower(text), 'aircraft') OR contains(lower(text), 'flight') OR contains(lower(text), 'dgca')) AS relevant FROM documents")
def dataset_relevance(spark, d):
    """[N-23, P-8]"""
    return table(spark, d, "documents").select("doc_id", (F.size(cells.relevance(F.col("text"))) > 0).alias("relevant"))


@query("secret_redaction", "SELECT page_id, regexp_replace(url || '&api-key=s3cret' || CAST(page_id AS VARCHAR) || '&token=abc', '([?&](?:api-key|api_key|apikey|key|token|access_token)=)([^&\\s]+)', '\\1<redacted>', 'gi') AS url FROM pages")
def secret_redaction(spark, d):
    """[N-11]"""
    url = F.concat("url", F.lit("&api-key=s3cret"), F.col("page_id").cast("string"), F.lit("&token=abc"))
    return table(spark, d, "pages").select("page_id", cells.redacted(url).alias("url"))


@query("name_variants", "SELECT n_nationkey, upper(n_name) || ' (HAL AIRPORT)|' || upper(n_name) || '|HAL AIRPORT|' || upper(n_name) || ' (HAL )' AS variants FROM nation")
def name_variants(spark, d):
    """[N-6, N-7]"""
    cell = F.concat(F.lit("(दिल्ली) "), "n_name", F.lit("(hal airport)"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(cells.name_variants(cell), "|").alias("variants"))


@query("name_resolution", """WITH names AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' (Cargo)' WHEN s_suppkey % 3 = 1 THEN n_name ELSE 'nowhere ' || CAST(s_suppkey % 5 AS VARCHAR) END AS raw, n_name AS nm, s_suppkey % 3 AS k, CAST(n_regionkey + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS VARCHAR) AS country, CAST(n_regionkey AS VARCHAR) AS home, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT DISTINCT raw, country, CASE WHEN k < 2 THEN code END AS iata, CASE WHEN k = 2 THEN 0.0 WHEN country = home THEN 1.0 ELSE 0.75 END AS confidence FROM names""")
def name_resolution(spark, d):
    """[N-8, N-9, N-25]"""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat("n_name", F.lit(" (Cargo)"))).when(k == 1, F.col("n_name")).otherwise(F.concat(F.lit("nowhere "), (F.col("s_suppkey") % 5).cast("string")))
    country = (F.col("n_regionkey") + F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(1)).cast("string")
    names = s.select(raw.alias("raw"), country.alias("country")).withColumn("variants", cells.name_variants(F.col("raw")))
    airports = n.select(F.upper("n_name").alias("name"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iata"), F.col("n_regionkey").cast("string").alias("country"), F.lit(True).alias("is_international"), F.col("n_nationkey").alias("file_order"))
    return warehouse.resolve(names, airports).drop("method")


@query("valid_split", """SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'no provenance' WHEN o_totalprice < 5000 THEN 'tonnage out of range' WHEN o_orderkey % 2 = 0 AND o_custkey % 20 = 0 THEN 'no airport' WHEN o_orderkey % 2 = 1 AND o_custkey % 30 = 0 THEN 'no airline' ELSE 'valid' END AS reason FROM orders) GROUP BY reason""")
def valid_split(spark, d):
    """[F-11, N-27, N-28]"""
    o = table(spark, d, "orders")
    code = F.col("o_custkey").cast("string")
    f = o.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("source_document_id"), F.when(F.col("o_totalprice") >= 5000, F.col("o_totalprice")).otherwise(-1.0).alias("tonnage_kg"), F.when(F.col("o_orderkey") % 2 == 0, "AIRPORT").otherwise("AIRLINE").alias("grain"), F.when(F.col("o_custkey") % 20 != 0, code).alias("airport_iata"), F.when(F.col("o_custkey") % 30 != 0, code).alias("airline_name"))
    ok, bad = warehouse.split_valid(f)
    return ok.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


@query("extraction_scores", "SELECT o_custkey AS doc, round(greatest(0.0, least(1.0, 0.6 * coalesce(sum(o_orderkey % 5) / nullif(sum(o_orderkey % 5 + 2), 0), 0) + 0.4 * coalesce(sum(least(o_orderkey % 5, 2)) / nullif(sum(o_orderkey % 5), 0), 0) - least(0.3, 0.05 * sum(o_orderkey % 3)))), 3) AS score FROM orders GROUP BY 1")
def extraction_scores(spark, d):
    """[N-24]"""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (k % 5).alias("kept"), (k % 5 + 2).alias("seen"), F.least(k % 5, F.lit(2)).alias("resolved"), (k % 3).alias("warnings"))
    return warehouse.extraction_score(rows, ["doc"])


@query("link_extraction", """SELECT DISTINCT page_id, CASE WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h WHEN h LIKE '/%' THEN host || h ELSE host || '/' || h END AS link FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)""")
def link_extraction(spark, d):
    """[S-17]"""
    return readers.links(table(spark, d, "pages"))


@query("link_ladder", """WITH l AS (SELECT DISTINCT page_id, CASE WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h WHEN h LIKE '/%' THEN host || h ELSE host || '/' || h END AS link FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages)),
  r AS (SELECT *, CASE WHEN regexp_matches(link, '/[tT]h[a-z]*$') THEN 0 WHEN regexp_matches(link, '/[a-z]+$') THEN 1 WHEN regexp_matches(link, '/') THEN 2 END AS rung FROM l) SELECT page_id, link, rung FROM (SELECT *, min(rung) OVER (PARTITION BY page_id) AS best FROM r) WHERE rung = best""")
def link_ladder(spark, d):
    """[S-18]"""
    return readers.laddered(readers.links(table(spark, d, "pages")), ["/[tT]h[a-z]*$", "/[a-z]+$", "/"])


@query("media_sniff", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/html' WHEN 3 THEN 'text/csv' ELSE 'application/octet-stream' END AS media_type, page_id % 5 IN (1, 2, 3, 4) AS mismatch FROM pages""")
def media_sniff(spark, d):
    """[S-12, S-13]"""
    k = F.col("page_id") % 5
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(k == 1, F.concat(F.lit('{"a": '), F.col("page_id").cast("string"), F.lit("}"))).when(k == 2, F.col("html")).otherwise("{ plain text")
    p = table(spark, d, "pages").select("page_id", body.alias("body"), F.when(k == 3, "text/csv; charset=utf-8").alias("declared"))
    sniffed = cells.media_type(F.col("body"), F.col("declared"))
    return p.select("page_id", sniffed.alias("media_type"), cells.type_mismatch(F.lit("http://x/y.pdf?v=1"), sniffed).alias("mismatch"))


@query("archive_probing", "SELECT 'https://x.example/' || strftime(m, '%Y') || '/' || strftime(m, '%m') || '.pdf' AS url FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m) WHERE m NOT IN (SELECT date_trunc('month', o_orderdate) FROM orders)")
def archive_probing(spark, d):
    """[S-19, J-12]"""
    known = table(spark, d, "orders").select(F.date_format("o_orderdate", "'https://x.example/'yyyy'/'MM'.pdf'").alias("url"))
    return readers.probes(known, "https://x.example/%04d/%02d.pdf", "1995-01-01", "2001-12-01")


@query("api_discovery", "SELECT 'https://x.example/api?c=' || n_name || '&y=' || y AS url FROM nation CROSS JOIN (SELECT unnest(['2020', '2021']) AS y)")
def api_discovery(spark, d):
    """[S-16]"""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]
    return readers.api_urls(spark, "https://x.example/api?c={c}&y={y}", {"c": names, "y": ["2020", "2021"]})


@query("content_archive", "SELECT sha256, count(*) AS copies FROM (SELECT sha256(text) AS sha256 FROM documents) GROUP BY sha256 HAVING count(*) > 1")
def content_archive(spark, d):
    """[S-14]"""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("jsonstat_decode", "SELECT c_custkey AS idx, ['A', 'B'][(c_custkey // 15) % 2 + 1] AS freq, ['x', 'y', 'z'][(c_custkey // 5) % 3 + 1] AS unit, ['1', '2', '3', '4', '5'][c_custkey % 5 + 1] AS time, c_acctbal AS value FROM customer")
def jsonstat_decode(spark, d):
    """[S-9]"""
    flat = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))
    return readers.json_stat(flat, [("freq", ["A", "B"]), ("unit", ["x", "y", "z"]), ("time", ["1", "2", "3", "4", "5"])])


@query("metric_mining", "SELECT p_partkey, 'freight_tonnes' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'departures', p_retailprice FROM part UNION ALL SELECT p_partkey, 'ftk_million', p_size * 2.0 FROM part")
def metric_mining(spark, d):
    """[S-10]"""
    wide = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("cargo_carried_ton__freight"), F.col("p_retailprice").alias("aircraft_flown_departures"), (F.col("p_size") * 2.0).alias("ton_kms_performed_freight"), F.lit(1.0).alias("remarks"))
    return readers.operating_metrics(wide, ["p_partkey"])


@query("carried_sections", """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 'INTERNATIONAL' WHEN 1 THEN 'DOMESTIC' END AS h FROM orders)
  SELECT doc_id, line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM r""")
def carried_sections(spark, d):
    """[S-5, S-7] A table section carried on until the next heading."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "A. International").when(k == 1, "Domestic freight").otherwise("1 DELHI 23")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.floor(F.col("o_orderkey") / 40).alias("page"), F.col("o_orderkey").alias("line"), text.alias("text"))
    return readers.carried_sections(rows).select("doc_id", "line", "section")


# ---- traces: a conversation stands for a run, its turns for steps

_TRACE = """step AS (SELECT conv_id AS run_id, turn AS seq, role AS tool, text AS observation, length(text) % 7 <> 0 AS ok, length(text) AS elapsed_ms, CASE WHEN turn % 4 = 3 THEN 'heuristic (after model failure)' WHEN turn % 2 = 0 THEN 'model' ELSE 'heuristic' END AS policy FROM conversations)"""


def _steps(spark, d):
    n, t = F.length("text"), F.col("turn")
    policy = F.when(t % 4 == 3, "heuristic (after model failure)").when(t % 2 == 0, "model").otherwise("heuristic")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), t.alias("seq"), F.col("role").alias("tool"), F.col("text").alias("observation"), (n % 7 != 0).alias("ok"), n.alias("elapsed_ms"), policy.alias("policy"))


@query("tool_stats", f"WITH {_TRACE} SELECT tool, count(*) AS calls, count(*) FILTER (ok) AS ok_calls, count(*) FILTER (NOT ok) AS failed, round(avg(elapsed_ms), 6) AS avg_ms, max(elapsed_ms) AS max_ms, count(DISTINCT run_id) AS runs FROM step GROUP BY tool")
def tool_stats(spark, d):
    """[A-8, J-7]"""
    return traces.tool_stats(_steps(spark, d))


@query("trace_rollup", f"WITH {_TRACE} SELECT run_id, count(*) AS steps, sum(elapsed_ms) AS total_ms, min(seq) AS first_seq, max(seq) AS last_seq, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM step GROUP BY run_id")
def trace_rollup(spark, d):
    """[A-9, A-10, P-13]"""
    return traces.rollup(_steps(spark, d))


@query("effective_policy", f"WITH {_TRACE}, run AS (SELECT DISTINCT run_id FROM step) SELECT run_id, (SELECT count(*) FROM step s WHERE s.run_id = r.run_id AND NOT ok) AS failed_steps, CASE WHEN (SELECT count(*) FROM step s WHERE s.run_id = r.run_id AND policy = 'model') = 0 THEN 'heuristic' WHEN (SELECT count(*) FROM step s WHERE s.run_id = r.run_id AND policy LIKE 'heuristic (%') > 0 THEN 'mixed' ELSE 'model' END AS effective_policy FROM run r")
def effective_policy(spark, d):
    """[J-19, F-7, W-27] The correlated counts as one conditional aggregate."""
    return traces.effective_policy(_steps(spark, d))


@query("trace_sessions", f"WITH {_TRACE} SELECT run_id, seq, sum(CASE WHEN tool = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS session FROM step")
def trace_sessions(spark, d):
    """[S-26, W-27]"""
    return traces.sessions(_steps(spark, d), "user").select("run_id", "seq", "session")


@query("spin_guard", """WITH step AS (SELECT conv_id AS run_id, turn AS seq, role AS tool, turn % 3 AS args, length(text) % 3 <> 0 AS ok, CASE WHEN length(text) % 2 = 0 THEN 'timeout' ELSE 'no rows' END AS observation FROM conversations)
  SELECT run_id, seq FROM (SELECT *, lag(observation) OVER (PARTITION BY run_id, tool, args ORDER BY seq) AS o1 FROM step WHERE NOT ok) WHERE o1 = observation""")
def spin_guard(spark, d):
    """[W-28] Calls with arguments, a third of which fail in one of two ways."""
    n = F.length("text")
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("tool"), (F.col("turn") % 3).alias("args"), (n % 3 != 0).alias("ok"), F.when(n % 2 == 0, "timeout").otherwise("no rows").alias("observation"))
    return traces.spinning(steps).select("run_id", "seq")


@query("policy_arms", f"WITH {_TRACE}, r AS (SELECT run_id, run_id % 2 AS arm, count(*) AS steps, bool_and(ok) AS success, sum(elapsed_ms) AS ms FROM step GROUP BY ALL) SELECT arm, count(*) AS runs, round(avg(steps), 6) AS mean_steps, median(steps) AS median_steps, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_pct, round(avg(ms), 6) AS ms_per_doc FROM r GROUP BY arm")
def policy_arms(spark, d):
    """[A-26, P-15]"""
    return traces.arms(_steps(spark, d).withColumn("arm", F.col("run_id") % 2))


@query("runs_page", f"WITH {_TRACE} SELECT run_id, count(*) AS steps FROM step GROUP BY run_id ORDER BY steps DESC, run_id LIMIT 20 OFFSET 10")
def runs_page(spark, d):
    """[L-5]"""
    return _steps(spark, d).groupBy("run_id").agg(F.count("*").alias("steps")).orderBy(F.desc("steps"), "run_id").offset(10).limit(20)


# ---- retrieval

_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: len(t) > 2 AND NOT regexp_matches(t, '^\\d+$') AND t NOT IN (" + ", ".join(f"'{w}'" for w in cells.STOP_WORDS) + "))"
_VOCAB = f"""vocab AS (SELECT token, df, least(8.0, ln((n + 1) / (df + 1)) + 1) AS idf FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY token), (SELECT count(*) AS n FROM documents) WHERE len(token) <= 64)"""


@query("idf_vocabulary", f"WITH {_VOCAB} SELECT token, df, round(idf, 8) AS idf FROM vocab")
def idf_vocabulary(spark, d):
    """[A-27, R-6, R-8]"""
    return retrieval.vocabulary(table(spark, d, "documents")).withColumn("idf", F.round("idf", 8))


@query("chunk_dedupe", "SELECT doc_id, md5(text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def chunk_dedupe(spark, d):
    """[R-7]"""
    p = table(spark, d, "documents").select("doc_id", F.lit(0).alias("seq"), F.col("text").alias("content"))
    return retrieval.first_of_each(p).select("doc_id", F.md5("content").alias("hash"))


@query("passages")
def passages(spark, d):
    """[R-1 to R-3] A fold over paragraphs; tested against a loop."""
    return retrieval.chunks(table(spark, d, "documents"))


@query("vector_topk", "WITH q AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), q) / (sqrt(list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), list_transform(embedding, lambda v: CAST(v AS DOUBLE)))) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, q) SELECT vec_id, round(score, 9) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20")
def vector_topk(spark, d):
    """[R-12]"""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 7").select("embedding").head()[0]
    return retrieval.dense(v, q, 5).withColumn("score", F.round("score", 9))


_QUERY = "for erth onneed thion tiont"
_LEX = f"""WITH {_VOCAB}, ask AS (SELECT v.*, max(idf) OVER () AS top FROM vocab v WHERE token IN ('erth', 'onneed', 'thion', 'tiont')), pick AS (SELECT token, idf FROM ask WHERE idf >= 0.6 * top ORDER BY idf DESC, token LIMIT 4),
  tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL), lex AS (SELECT doc_id, sum((1 + ln(tf)) * idf) AS score FROM tf JOIN pick USING (token) GROUP BY doc_id)"""


@query("lexical_topk", f"{_LEX} SELECT doc_id, round(score, 8) AS score FROM lex ORDER BY lex.score DESC, doc_id LIMIT 20")
def lexical_topk(spark, d):
    """[R-13]"""
    docs = table(spark, d, "documents")
    return retrieval.lexical(docs, retrieval.vocabulary(docs), _QUERY, 5).withColumn("score", F.round("score", 8))


@query("rrf_fusion", "WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY lang, doc_id) AS rank FROM documents) SELECT id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY id")
def rrf_fusion(spark, d):
    """[R-14]"""
    docs = table(spark, d, "documents")
    a = docs.select("doc_id", F.col("n_chars").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    b = docs.select("doc_id", "lang").orderBy("lang", "doc_id").limit(20)
    b = b.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy("lang", "doc_id")).alias("rank"))  # 20 rows
    return retrieval.fused(retrieval.ranked(a, "doc_id"), b).withColumn("score", F.round("score", 12))


@query("hybrid_search")
def hybrid_search(spark, d):
    """[R-15] Dense and lexical lists fused."""
    docs, v = table(spark, d, "documents"), table(spark, d, "embeddings")
    q = v.where("vec_id = 7").select("embedding").head()[0]
    return retrieval.search(docs, v, retrieval.vocabulary(docs), _QUERY, q)


@query("hashed_vectors")
def hashed_vectors(spark, d):
    """[R-9] Sparse signed hashed TF-IDF."""
    docs = table(spark, d, "documents")
    return retrieval.hashed_vectors(docs, retrieval.vocabulary(docs))


# ---- questions and grounding


@query("intent_classification", """WITH q AS (SELECT c_custkey AS id, ['Which airports grew fastest?', 'What is the largest airline?', 'Any unusual spike?', 'Forecast for next year', 'Show the trend over time', 'Where does the data come from?', 'Tell me a joke'][c_custkey % 7 + 1] AS text FROM customer)
  SELECT id, [ 'airport_ranking', 'airline_ranking', 'anomaly_list', 'forecast_list', 'airport_trend', 'source_list', NULL][id % 7 + 1] AS intent, 'TOTAL' AS direction, id % 7 = 0 AS wants_growth FROM q""")
def intent_classification(spark, d):
    """[G-1, G-2]"""
    texts = ["Which airports grew fastest?", "What is the largest airline?", "Any unusual spike?", "Forecast for next year", "Show the trend over time", "Where does the data come from?", "Tell me a joke"]
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.get(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 7).cast("int")).alias("text"))
    c = F.col("text")
    return q.select("id", traces.intent(c).alias("intent"), traces.asked_direction(c).alias("direction"), traces.wants_growth(c).alias("wants_growth"))


@query("grounding_check", "SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS grounded FROM orders")
def grounding_check(spark, d):
    """[G-4, G-5]"""
    o = table(spark, d, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 12345.6).otherwise(F.col("o_totalprice"))
    text = F.format_string("In 2001-07 the 20 airports moved %,.1f MT", shown)
    return o.select(F.col("o_orderkey").alias("id"), cells.grounded(text, F.array("o_totalprice"), F.lit(1)).alias("grounded"))


@query("event_upserts", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def event_upserts(spark, d):
    """[2.12] What the stream of upserts converges to: the last write of a key."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
