"""The registered query of each training-data operator: the operator with
production parameters over its whole table, and the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, cotraining, imatch, linededup, mixing, packing, simhash, substring, token_files, warc
from tidemark.llm.shared import Scratch, table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    manifest = token_files.write(table(spark, sf_dir, "documents"), scratch, vocabulary("byte_bpe_50k.json"))
    return token_files.entries(manifest)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return warc.read(warc.write(table(spark, sf_dir, "pages"), scratch)).drop("url", "digest_ok")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.without_duplicate_lines(docs)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")).taken()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_warc, op3_substring_dedup, op4_line_dedup, op5_imatch, op6_best_fit_packing, op7_cotraining, op8_learned_partitions, op9_mixing, op10_simhash)}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS key FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
  m AS (SELECT key, min(doc_id) AS lo FROM k GROUP BY key),
  r AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS pos FROM k JOIN m USING (key) WHERE doc_id > lo) GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op4_line_dedup": """WITH l AS (SELECT doc_id, at_, line, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM documents WHERE text IS NOT NULL)),
  c AS (SELECT s, len(s) AS n, row_number() OVER (ORDER BY min((doc_id, at_))) AS id, min((doc_id, at_)) AS first FROM l WHERE len(s) > 0 GROUP BY s),
  t AS (SELECT id, n, unnest(s) AS w FROM c WHERE n >= 4), f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
  p AS (SELECT id, n, w FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY df, w) AS r FROM t JOIN f USING (w)) WHERE r <= n // 5 + 1),
  q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
  gone AS (SELECT DISTINCT a FROM q JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
  j AS (SELECT l.doc_id, l.at_, l.line, len(l.s) > 0 AND (g.a IS NOT NULL OR (l.doc_id, l.at_) <> c.first) AS out_ FROM l LEFT JOIN c ON l.s = c.s LEFT JOIN gone g ON g.a = c.id),
  o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out_) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY at_) FILTER (NOT coalesce(out_, FALSE)), '') AS kept FROM j GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)""",
}
