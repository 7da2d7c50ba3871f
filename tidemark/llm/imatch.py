"""I-Match document fingerprints with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band of shares of
all documents. A document's terms in the lexicon, sorted and distinct, are hashed
within each of several random subsets of the lexicon. Subsets come at three
rates, so that short and long documents alike have some that hold few of their
terms; the likeness of two fingerprints is the share of equal hashes among the
subsets at the finest rate that tells enough.

Terms are counted in ``2^20`` hash buckets first; in buckets that reach the band's
lower end each term is then counted by its 64-bit hash and held against the band.
A document's distinct terms over the lower share bound the lexicon, whatever the
corpus; it is a literal of the plan.

All of it is built-in expressions. Null text is empty; a document with no term
in the lexicon takes a hash of its whole text instead; rows follow one another
by descending id, then by a hash of the text; null ids come last; repeated rows
are separate documents; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, in_total_order

BUCKETS = 20
LEADING = 16
#: Subsets at each rate: (taken, out of).
RATES = ((16, 16), (16, 128), (16, 1024))
ENOUGH = 6
_NONE = "-" * 8


def _hashes(text: Column) -> Column:
    """The hashes of the distinct terms."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), lambda t: F.xxhash64(t)))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKETS)


def lexicon(docs: DataFrame, low: float, high: float) -> tuple[Column, Column]:
    """The sorted hashes of the terms of the band, and for each value of their
    leading bits the number of hashes before it. Counts cover all documents."""
    n = docs.count()
    least = max(2.0, low * n)
    buckets = docs.select(F.explode(F.array_distinct(F.transform(_hashes(F.col("text")), _bucket))).alias("b"))
    kept = buckets.groupBy("b").agg(F.count("*").alias("df")).where(F.col("df") >= least)  # may hold a common term beside
    words = kept.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    found = dict(words.collect())  # at most 2^14 words, whatever the corpus
    bits = _literal([found.get(w, 0) for w in range(1 << (BUCKETS - 6))])

    def able(h: Column) -> Column:
        b = _bucket(h)
        return F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63)) == 1

    terms = docs.select(F.explode(F.filter(_hashes(F.col("text")), able)).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    terms = terms.where((F.col("df") >= least) & (F.col("df") <= high * n)).select("h").collect()
    hashes = sorted((r["h"] for r in terms), key=lambda h: h % (1 << 64))
    starts = [0] * ((1 << LEADING) + 1)
    for h in hashes:
        starts[(h % (1 << 64) >> (64 - LEADING)) + 1] += 1
    return _literal(hashes), _literal([*accumulate(starts)])


def _literal(numbers: list[int]) -> Column:
    if not numbers:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")  # folded to a literal


def _terms(text: Column, lexicon: tuple[Column, Column]) -> Column:
    hashes, starts = lexicon

    def kept(h: Column) -> Column:
        at = F.shiftrightunsigned(h, 64 - LEADING).cast("int")
        first = F.get(starts, at).cast("int")
        return F.array_contains(F.slice(hashes, first + 1, F.get(starts, at + 1).cast("int") - first), h)

    return F.sort_array(F.filter(_hashes(text), kept))


def fingerprint(text: Column, lexicon: tuple[Column, Column]) -> Column:
    """48 subset hashes of 8 digits, and one of the whole lexicon of 16."""
    terms = F.transform(F.array(_terms(text, lexicon)), lambda t: F.concat(_subsets(t), F.when(F.size(t) > 0, F.lpad(F.hex(F.xxhash64(t)), 16, "0")).otherwise(F.lpad(F.hex(F.xxhash64(text, F.lit(1))), 16, "0"))))
    return F.lower(F.element_at(terms, 1))


def _subsets(terms: Column) -> Column:
    return F.concat(*[_at_rate(terms, taken, of, 4 + 10 * r) for r, (taken, of) in enumerate(RATES)])


def _at_rate(terms: Column, taken: int, of: int, shift: int) -> Column:
    def cell(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(of - 1)

    def hashed(own: Column) -> Column:
        return F.when(F.size(own) == 0, _NONE).otherwise(F.lpad(F.hex(F.hash(own).cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))

    def subsets(some: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(taken - 1)), lambda j: hashed(F.filter(some, lambda h: cell(h) == j)))
        return F.array_join(each, "")

    some = F.filter(terms, lambda h: cell(h) < taken) if taken < of else terms
    return F.element_at(F.transform(F.array(some), subsets), 1)


def _cut(fingerprint: Column, at: Column) -> Column:
    return F.substring(fingerprint, at, F.lit(8))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal ones, else the share of equal subset
    hashes at the finest rate with ``ENOUGH`` subsets that hold a term of either."""
    shares, at = [], 0
    for taken, _ in RATES:
        places = F.sequence(F.lit(at + 1), F.lit(at + 8 * taken - 7), F.lit(8))
        told = F.size(F.filter(places, lambda i: (_cut(a, i) != _NONE) | (_cut(b, i) != _NONE)))
        same = F.size(F.filter(places, lambda i: (_cut(a, i) != _NONE) & (_cut(a, i) == _cut(b, i))))
        shares.append((told, same / F.greatest(told, F.lit(1))))
        at += 8 * taken
    (n1, s1), (n2, s2), (n3, s3) = shares
    share = F.when(n3 >= ENOUGH, s3).when(n2 >= ENOUGH, s2).when(n1 > 0, s1).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(share).cast("double")


def with_next(docs: DataFrame, scratch: Scratch, print_of: Callable[[Column], Column]) -> DataFrame:
    """Rows (doc_id, text) with ``print``, that of the text, and ``next``, text and
    print of the following row by descending id, after the last the first. Texts
    move once, to ranges of ids; only the first row of each range goes to another,
    and is the only one whose print is made twice."""
    # ids are small, texts aren't: several ranges for each shuffle partition of the texts
    ranges = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = in_total_order(docs.select("doc_id"), [F.desc_nulls_last("doc_id")], scratch, "order", ranges)
    lows = [r["low"] for r in placed.groupBy("_pid").agg(F.max("doc_id").alias("low")).collect()]  # one for each partition
    lows = sorted({x for x in lows if x is not None}, reverse=True)
    bounds = F.array(*[F.lit(x) for x in lows]) if lows else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), len(lows)).otherwise(F.size(F.filter(bounds, lambda b: b >= F.col("doc_id"))))
    ranged = docs.withColumns({"_bucket": bucket, "_h": F.xxhash64("text")})
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("d"), (-F.col("_h").cast("decimal(20,0)")).alias("h"))
    firsts = scratch.cut(ranged.groupBy("_bucket").agg(F.max_by("text", place).alias("text")), "firsts")
    firsts = scratch.cut(firsts.select("_bucket", F.struct("text", print_of(F.col("text")).alias("print")).alias("_first")), "first-prints")
    w = Window.orderBy("_bucket")  # one row for each range
    follow = firsts.select("_bucket", F.coalesce(F.lead("_first").over(w), F.first("_first").over(w)).alias("_n"))
    follow = scratch.cut(follow.withColumnRenamed("_bucket", "_b"), "follow")
    led = ranged.withColumn("print", print_of(F.col("text"))).withColumn("_lead", F.lead(F.struct("text", "print")).over(Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), "_h")))
    joined = led.join(follow, (F.col("_bucket") == F.col("_b")) & F.col("_lead").isNull(), "left")
    return joined.select("doc_id", "text", "print", F.coalesce("_lead", "_n").alias("next"))


def fingerprints(docs: DataFrame, low: float = 0.0005, high: float = 0.2, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprints of documents and of their edited texts: the last half of the
    code points replaced by the first as many of the next document."""
    scratch = scratch or Scratch(docs.sparkSession, "imatch")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    held = lexicon(docs, low, high)
    pairs = with_next(docs, scratch, lambda text: fingerprint(text, held))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next.text", half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    prints = pairs.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited"), held).alias("edited_fingerprint"))
    return prints.select("doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), "edited_fingerprint", likeness(F.col("print"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
