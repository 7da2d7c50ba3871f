"""Passage retrieval: chunks, vocabulary, vectors, lexical and dense search, fusion."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cells import tokens

MAX_IDF = 8.0
TARGET, OVERLAP = 1280, 192


def normalised(text: Column) -> Column:
    """[R-1] Runs of blanks to one, of empty lines to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """[R-2, R-3] Paragraphs gathered to passages of about ``target`` characters,
    the tail of one carried to the next; passages under 40 characters are left out.

    A fold over the paragraphs: sequential within a document, native, one pass.
    """
    paragraphs = F.filter(F.transform(F.split(normalised(F.col("text")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def wrapped(out: Column, buf: Column) -> Column:
        """Cuts a buffer beyond 1.6 targets into overlapping pieces."""
        step, most = target - overlap, int(target * 1.6)
        n = F.greatest(F.lit(0), F.ceil((F.length(buf) - most) / step)).cast("int")
        cut = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.substring(buf, i * step + 1, F.lit(target)))
        return F.struct(F.concat(out, cut).alias("out"), F.substring(buf, n * step + 1, F.length(buf)).alias("buf"))

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["buf"]) + F.length(p) + 2 <= target
        joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
        tail = F.when(F.length(s["buf"]) > overlap, F.right(s["buf"], F.lit(overlap))).otherwise(s["buf"])
        out = F.when(fits | (s["buf"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))
        buf = F.when(fits | (s["buf"] == ""), joined).otherwise(F.concat(tail, F.lit("\n\n"), p))
        return F.when(fits, F.struct(out.alias("out"), buf.alias("buf"))).otherwise(wrapped(out, buf))

    done = F.aggregate(paragraphs, empty, add, lambda s: F.when(F.trim(s["buf"]) != "", F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"]))
    return docs.select("doc_id", F.posexplode(done).alias("seq", "content")).where(F.length("content") >= 40).withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int"))


def record_chunks(records: DataFrame, most: int = 60) -> DataFrame:
    """[R-4] The first records of each document as 'k: v' lines; ``fields`` is a map."""
    lines = F.array_join(F.transform(F.map_entries(F.map_filter("fields", lambda _, v: v.isNotNull() & (F.trim(v) != ""))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return records.where(F.col("record_no") < most).select("doc_id", "record_no", lines.alias("content")).where(F.length("content") >= 30)


def first_of_each(passages: DataFrame) -> DataFrame:
    """[R-7] Of passages of equal content the first by document and place."""
    w = Window.partitionBy(F.md5("content")).orderBy("doc_id", "seq")
    return passages.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vocabulary(docs: DataFrame) -> DataFrame:
    """[A-27, R-6, R-8] Tokens with document frequency and capped IDF."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.least(F.lit(MAX_IDF), F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return df.where(F.length("token") <= 64).join(F.broadcast(n)).select("token", "df", idf.alias("idf"))  # n: one row


def places(vocab: DataFrame, dims: int = 1024) -> DataFrame:
    """[R-9] Each distinct ``token`` with its place and sign, from BLAKE2b of eight
    bytes, which Spark hasn't: hashed once a word, not once an occurrence."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            place, sign = (np.array([blake2b((salt + w).encode(), digest_size=8).digest() for w in words], "S8") for salt in ("", "sign"))
            place, sign = (np.frombuffer(x.tobytes(), ">u8") if len(x) else np.zeros(0, ">u8") for x in (place, sign))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((place % dims).astype(np.int32)), pa.array(np.where(sign % 2 == 1, 1.0, -1.0))], names=["token", "place", "sign"])

    return vocab.select("token").mapInArrow(each, "token string, place int, sign double")


def hashed_vectors(docs: DataFrame, vocab: DataFrame, dims: int = 1024) -> DataFrame:
    """[R-9] Signed hashed TF-IDF vectors of unit length, sparse: one row for each
    document and filled place. Words that ``vocab`` lacks weigh the most."""
    tf = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    at = places(tf.select("token").distinct(), dims)
    w = tf.join(at, "token").join(vocab.select("token", "idf"), "token", "left")
    w = w.withColumn("w", F.col("sign") * (1 + F.ln("tf")) * F.coalesce("idf", F.lit(MAX_IDF)))
    v = w.groupBy("doc_id", "place").agg(F.sum("w").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return v.withColumn("x", F.try_divide("x", norm)).where("x <> 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """[R-12] The ``max(4k, 20)`` nearest by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    cosine = F.try_divide(dot(F.col("embedding"), q), F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(q, q)))
    return vectors.select("vec_id", cosine.alias("score")).orderBy(F.desc_nulls_last("score"), "vec_id").limit(max(4 * k, 20))


def lexical(docs: DataFrame, vocab: DataFrame, query: str, k: int) -> DataFrame:
    """[R-13] Documents with the query's discriminative terms: known, of at least
    0.6 of the top IDF, four at most; ranked by the sum of (1 + ln tf) idf."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("token"))
    known = vocab.join(F.broadcast(asked), "token").withColumn("top", F.max("idf").over(Window.partitionBy()))  # the query's words
    chosen = known.where("idf >= 0.6 * top").orderBy(F.desc("idf"), "token").limit(4).select("token", "idf")
    tf = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).join(F.broadcast(chosen), "token")
    scored = tf.groupBy("doc_id", "token", "idf").agg(F.count("*").alias("tf")).groupBy("doc_id").agg(F.sum((1 + F.ln("tf")) * F.col("idf")).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(4 * k, 20))


def fused(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """[R-14] Reciprocal rank fusion of frames (id, rank from 1)."""
    parts = ranked[0]
    for r in ranked[1:]:
        parts = parts.unionByName(r)
    return parts.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def ranked(frame: DataFrame, id_: str) -> DataFrame:
    """Rank of a short list (already limited) by score."""
    w = Window.orderBy(F.desc("score"), id_)
    return frame.select(F.col(id_).alias("id"), F.row_number().over(w).alias("rank"))


def search(docs: DataFrame, vectors: DataFrame, vocab: DataFrame, text: str, vector: list[float], k: int = 5) -> DataFrame:
    """[R-15] Hybrid search: dense and lexical lists fused, the best ``k``."""
    both = fused(ranked(dense(vectors, vector, k), "vec_id"), ranked(lexical(docs, vocab, text, k), "doc_id"))
    return both.orderBy(F.desc("score"), "id").limit(k)
