"""Each training-data operator against a brute-force version, with nulls, empty
and repeated rows, ties, empty tables and clashing extra columns."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, components, cotraining, imatch, linededup, mixing, packing, queries, shared, shingles, simhash, substring, token_files, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0, sources=("b", "a", None, "c")):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(start + i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    clash = ("id", "th", "doc", "at", "size", "row_id", "fp", "node", "word", "_pid", "h1", "n", "removed", "keep", "score", "part", "rank")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})


def corpus(rng, n=60):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["Ünï", "日本", "A\x1cB", "x\xa0y"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(60)
    out = [None, "", " ", "one", "a b", "  two  spaces\t\n end ", text(4000)]
    while len(out) < n:
        t = text(rng.randint(1, 200))
        kind = rng.random()
        if kind < 0.15 and out[-1]:
            t = out[-1]
        elif kind < 0.4:
            t = f"{text(10)} {passage}\n{text(20)}"
        elif kind < 0.5:
            t = "\n".join(text(rng.randint(0, 12)) for _ in range(8))
        out.append(t)
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus(random.Random(7))


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# ---- 1 token files


def test_token_files(spark, texts):
    scratch = shared.Scratch(spark, "t")
    df = docs(spark, texts).repartition(3)
    manifest = token_files.write(df, scratch, queries.vocabulary("byte_bpe_50k.json"), length=64, per_batch=4)
    got = sorted(tuple(r) for r in token_files.entries(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    encode, at, want = whole("byte_bpe_50k.json"), 0, []
    stream = []
    for i, t in enumerate(texts):
        ids = [*encode(t), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
        stream += ids
    assert got == want
    first = manifest.orderBy("shard").head()
    shard = token_files.Shard(first["path"])
    ids, mask = shard.sequence(0)
    assert len(ids) == 64 and mask.all() and ids.tolist() == stream[:64] and not ids.flags.owndata and not mask.flags.owndata
    at = 0
    for row in manifest.orderBy("shard").collect():  # every sequence by number, the last first
        shard = token_files.Shard(row["path"])
        for i in reversed(range(-(-row["tokens"] // 64))):
            ids, mask = shard.sequence(i)
            n = min(64, row["tokens"] - 64 * i)
            assert ids[:n].tolist() == stream[at + 64 * i : at + 64 * i + n] and mask.tolist() == [1] * n + [0] * (64 - n)
        at += row["tokens"]
    assert at == len(stream)


def test_masks_of_a_shard_are_kept_once(spark, texts):
    scratch = shared.Scratch(spark, "t")
    manifest = token_files.write(docs(spark, [t for t in texts if t] * 20).coalesce(1), scratch, queries.vocabulary("byte_bpe_50k.json"), length=64, per_batch=16)
    for row in manifest.collect():
        system, path = token_files.open_fs(row["path"])
        batches = -(-row["tokens"] // (64 * 16))
        assert row["tokens"] > 10_000 and system.get_file_info(path).size < 2.5 * row["tokens"] + 600 * batches  # a byte mask for each id took 3


def test_token_files_empty(spark):
    m = token_files.write(docs(spark, []), shared.Scratch(spark, "t"), queries.vocabulary("byte_bpe_50k.json"))
    assert token_files.entries(m).count() == 0


# ---- 2 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("refers_to", F.lit(1))


def test_warc(spark):
    rows = [(5, "http://a", "same"), (3, None, "same"), (9, "http://b", None), (8, "http://c", ""), (1, "http://d", "é" * 9000), (None, "http://e", "same"), (7, "http://f\n", "other")]
    m = warc.write(pages(spark, rows), shared.Scratch(spark, "w"))
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(m).collect()}
    first = {"same": 3, "": 8, "é" * 9000: 1, "other": 7}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        ok = i == first[h or ""]
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ok else "revisit", None if ok else first[h or ""]))
    assert got == want
    path = m.head()["path"].removeprefix("file:/")
    with gzip.open("/" + path.lstrip("/")) as f:  # any gzip reader takes the members in turn
        assert f.read().startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(pages(spark, []), shared.Scratch(spark, "w"))).count() == 0


def test_warc_reader_refuses():
    good = warc.record(1, "http://x", b"abc", None)
    assert next(warc.read_records(io.BytesIO(good + good)))["payload"] == b"abc"
    assert len(list(warc.members(io.BytesIO(good * 3), chunk=7))) == 3
    for bad in (good[:-5], b"nonsense", gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(warc.BadArchive):
            list(warc.read_records(io.BytesIO(bad)))
    text = gzip.decompress(good).replace(b"abc\r\n\r\n", b"abd\r\n\r\n")
    assert next(warc.read_records(io.BytesIO(gzip.compress(text))))["digest_ok"] is False


# ---- 3 substrings


def brute_substrings(texts, window):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,seed", [(50, 26), (6, 3)])
def test_substrings(spark, texts, window, seed):
    more = [*texts, "For " * 300, "For " * 200, " ".join(map(str, range(49))), " ".join(map(str, range(50))), " ".join(map(str, range(-3, 50)))]
    got = substring.remove_repeats(docs(spark, more).repartition(3), window=window, seed=seed)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_substrings(more, window)


def test_substrings_odd_rows(spark):
    same = " ".join(map(str, range(60)))
    twice = docs(spark, [same]).unionByName(docs(spark, [same]))  # of one id: none removes from the other
    assert [r["n_removed"] for r in substring.remove_repeats(twice).collect()] == [0, 0]
    null = docs(spark, [same]).unionByName(docs(spark, [same]).withColumn("doc_id", F.lit(None).cast("long")))
    assert {(r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(null).collect()} == {(0, 0), (None, 60)}
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_substrings_of_one_id_keep_their_own_places(spark):
    passage, clean = " ".join(map(str, range(60))), " ".join(map(str, range(100, 200)))
    rows = [(1, passage), (5, "a " + passage + " b"), (5, clean), (None, passage), (None, clean + " c"), (None, clean[4:])]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    # the texts of null ids after the first come after 5's
    want = [(1, 60, 0), (5, 62, 60), (5, 100, 0), (None, 60, 60), (None, 101, 100), (None, 99, 99)]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()), key=str) == sorted(want, key=str)
    apart = spark.createDataFrame([(1, passage), (None, passage), (None, clean), (None, clean)], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_removed"]) for r in substring.remove_repeats(apart).collect()) == [(60, 0), (60, 60), (100, 0), (100, 0)]


# ---- 4 lines


def brute_lines(texts):
    seen, out = [], []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        kept, own = [], []
        for line in t.split("\n"):
            s = frozenset(line.encode().split())
            if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
                own.append(s)
        out.append("\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(1, 14))) for _ in range(25)]

    def variant(line):
        w = line.split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice("abcxyz") * 3
        rng.shuffle(w)
        return "  ".join(w)

    texts = [None, "", "\n\n", *("\n".join(variant(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(40))]
    df = docs(spark, texts)
    got = {r["doc_id"]: r["text"] for r in linededup.without_duplicate_lines(df.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    assert linededup.without_duplicate_lines(docs(spark, [])).count() == 0
    twice = linededup.without_duplicate_lines(docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"])))
    assert [r["text"] for r in twice.collect()] == ["a b c", "a b c"]  # one document
    null = linededup.without_duplicate_lines(docs(spark, ["a b c"]).unionByName(docs(spark, ["a b c"]).withColumn("doc_id", F.lit(None).cast("long"))))
    assert {(r["doc_id"], r["text"]) for r in null.collect()} == {(0, "a b c"), (None, "")}


@pytest.mark.parametrize("common, fetches", [(2, 2), (256, 1)])
def test_lines_of_other_sizes_and_crowded_words(spark, monkeypatch, common, fetches):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    base = [rng.sample(pool, n) for n in (4, 5, 8, 9, 10, 18, 19, 27, 40, 70, 90)]

    def variant(words):  # near 0.8 on both sides, of more and of fewer words
        w, edits = list(words), rng.randint(0, len(words) // 5 + 1)
        for _ in range(edits):
            if rng.random() < 0.5 and len(w) > 1:
                w.pop(rng.randrange(len(w)))
            else:
                w.append(rng.choice(pool))
        rng.shuffle(w)
        return rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " "])

    texts = ["\n".join(variant(rng.choice(base)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    fetched, own = [], linededup._sets
    monkeypatch.setattr(linededup, "_sets", lambda *a: fetched.append(1) or own(*a))
    monkeypatch.setattr(linededup, "COMMON", common)
    monkeypatch.setattr(linededup, "FEW", 1)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r["doc_id"]: r["text"] for r in linededup.without_duplicate_lines(docs(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < sum(t.count("\n") + 1 for t in want if t) < sum(t.count("\n") + 1 for t in texts) - 20
    assert len(fetched) == fetches  # the texts are fetched once, and once more for crowded words alone
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_lines_keep_rarity_out_of_plans_and_rows(spark):
    plans = {}

    class Spy(shared.Scratch):
        def cut(self, df, name):
            plans[name] = df._jdf.queryExecution().toString()
            return super().cut(df, name)

    found = linededup.without_duplicate_lines(docs(spark, ["a b c d e\nf\tg\r", "e d c b a\n g f"]), scratch=Spy(spark, "lines"))
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == ["a b c d e\nf\tg\r", ""]
    assert {"lines", "first-sets"} <= plans.keys() and max(map(len, plans.values())) < 100_000  # the driver keeps the text of every plan
    for name in ("lines", "first-sets"):
        optimized = plans[name].split("== Optimized Logical Plan ==")[1]
        assert "subquery" in optimized and "AS levels" not in optimized


def test_lines_avoid_the_writer_of_many_files(spark, monkeypatch):
    seen, own = [], linededup.rarity
    monkeypatch.setattr(linededup, "rarity", lambda d: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or own(d))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("200", "4", "1000"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            linededup.without_duplicate_lines(docs(spark, []))
            assert spark.conf.get("spark.sql.shuffle.partitions") == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert seen == ["201", "4", "1000"]


def test_lines_hash_texts_once_and_count_few_prefix_words(spark, monkeypatch):
    plans, maps, own = {}, [], linededup.rarity
    name = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    monkeypatch.setattr(linededup, "rarity", lambda d: maps.append(spark.conf.get(name)) or own(d))
    held = spark.conf.get(name, None)

    class Spy(shared.Scratch):
        def cut(self, df, name):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return super().cut(df, name)

    linededup.without_duplicate_lines(docs(spark, ["a b c d e\nf g", "e d c b a"]), scratch=Spy(spark, "lines"))
    assert maps == [str(linededup.BUCKETS)] and spark.conf.get(name, None) == held
    above, below = plans["lines"].split("Generate posexplode")
    assert "xxhash64(text" in below and "xxhash64(text" not in above  # not for each of its lines
    assert "word" in plans["common"] and "< 0)" in plans["common"]


@pytest.mark.parametrize("common", [3, 16])
def test_lines_tell_words_that_may_be_common(spark, monkeypatch, common):
    monkeypatch.setattr(linededup, "COMMON", common)
    words = [f"w{i}" for i in range(40) for _ in range(i + 1)]
    levels = linededup.rarity(docs(spark, [" ".join(words)]))
    often = levels.first()["often"]
    lines = spark.createDataFrame([(i, f"w{i}") for i in range(40)], "i int, line string")
    got = {r["i"]: r["x"][0] >= often for r in linededup.codes(lines, F.col("line"), levels, F.col("i")).collect()}
    assert all(got[i] for i in range(common, 40)) and not any(got[i] for i in range(common // 2))


def test_parities_differ_at_most_as_sets(spark):
    rng = random.Random(9)
    rows = []
    for n in (5, 60, 64, 65, 90, 300):
        x = [rng.getrandbits(63) - (1 << 62) for _ in range(n)]
        for k in (1, n // 5):
            rows += [(sorted(x), sorted(x[k:]), k), (sorted(x), sorted(x[k:] + [rng.getrandbits(63) for _ in range(k)]), 2 * k), (sorted(x), [rng.getrandbits(63) for _ in range(n)], 2 * n)]
    df = spark.createDataFrame(rows, "xa array<bigint>, xb array<bigint>, most int")
    of = {f"s{i}{c}": linededup._parities(F.col(f"x{c}"))[i] for c in "ab" for i in (0, 1)}
    found = df.withColumns(of).select("most", F.size("xa").alias("n"), linededup._differ().alias("d")).collect()
    assert all(r["d"] <= r["most"] for r in found)
    assert all(r["d"] > r["n"] / 4 for r in found if r["most"] == 2 * r["n"] and 60 <= r["n"] <= 90)  # and different sets are told apart


# ---- 5 I-Match


def test_imatch(spark, texts):
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs(spark, texts).repartition(3), low=0.03, high=0.5).collect()}
    n = len(texts)
    order = list(range(n - 1, -1, -1))
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % n]] or ""
        half = len(a) // 2
        r = got[i]
        assert r["n_chars"] == len(a)
        assert r["edited_sha256"] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for j in range(n):
            if (texts[j] or "") == a:
                assert got[j]["fingerprint"] == r["fingerprint"]
    alike = [r["near_edited"] for r in got.values() if r["n_chars"] > 200]
    other = [r["near_next"] for r in got.values() if r["n_chars"] > 200]
    assert np.mean(alike) > np.mean(other)
    assert imatch.fingerprints(docs(spark, [])).count() == 0
    one = imatch.fingerprints(docs(spark, ["only"])).head()
    assert one["near_next"] == 1.0 and one["fingerprint"] == imatch.fingerprints(docs(spark, ["only"])).head()["fingerprint"]


def test_imatch_lexicon_holds_the_band_alone(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKETS", 6)  # rare and common terms share buckets with those of the band
    rng = random.Random(3)
    rows = [" ".join({"the", *(f"band{rng.randrange(40)}" for _ in range(6)), f"rare{i}"}) for i in range(100)]
    df = {}
    for t in rows:
        for w in t.split():
            df[w] = df.get(w, 0) + 1
    hashes = imatch.lexicon(docs(spark, rows), 0.05, 0.5)[0]
    got = sorted(spark.range(1).select(hashes.alias("h")).head()["h"])
    band = [w for w, n in df.items() if 5 <= n <= 50]
    want = spark.createDataFrame([(w,) for w in band], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert band and got == sorted(r["h"] for r in want)
    kept = docs(spark, rows).select(imatch._terms(F.col("text"), imatch.lexicon(docs(spark, rows), 0.05, 0.5)).alias("t")).collect()
    assert [len(r["t"]) for r in kept] == [sum(w in band for w in t.split()) for t in rows]


def test_imatch_full_rate_takes_all_terms_as_they_are(spark):
    counts = [str(imatch._at_rate(F.col("t"), taken, of, 4)).count("filter(") for taken, of in ((16, 16), (16, 128))]
    assert counts[0] < counts[1]  # as many before


def murmur(longs, seed=42):
    """Spark's hash of an array of longs."""
    m, rot = 0xFFFFFFFF, lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = seed
    for x in longs:
        for k in (x & m, x >> 32 & m):
            h = (rot(h ^ rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h


def brute_prints(texts, low, high):
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    sets = [{h(w.decode()) for w in (t or "").encode().split()} for t in texts]
    df = {}
    for s in sets:
        for x in s:
            df[x] = df.get(x, 0) + 1
    kept = {x for x, n in df.items() if max(2, low * len(texts)) <= n <= high * len(texts)}

    def one(text, terms):
        terms = sorted(terms & kept, key=lambda x: x - (x >> 63 << 64))
        out = []
        for r, (taken, of) in enumerate(imatch.RATES):
            for j in range(taken):
                own = [x for x in terms if x >> (4 + 10 * r) & (of - 1) == j]
                out.append(f"{murmur(own):08x}" if own else "-" * 8)
        whole = 42
        for x in terms:
            whole = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), whole)
        if not terms:
            whole = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h(text or ""))
        return "".join(out) + f"{whole:016x}"

    return one, [one(t, s) for t, s in zip(texts, sets, strict=True)], lambda t: {h(w.decode()) for w in t.encode().split()}


def test_imatch_prints_by_brute_force(spark, texts):
    rows = [t for t in texts if t is not None]
    one, want, terms = brute_prints(rows, 0.03, 0.5)
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs(spark, rows).repartition(3), low=0.03, high=0.5).collect()}
    for i, t in enumerate(rows):
        assert got[i]["fingerprint"] == want[i]
        nxt = rows[i - 1]  # the last row's next is the first
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["edited_fingerprint"] == one(edited, terms(edited))
        if want[i] == want[i - 1]:
            assert got[i]["near_next"] == 1.0


def test_imatch_makes_each_print_once(spark, texts, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return f"{len(text):0400d}"

    monkeypatch.setattr(imatch, "fingerprint", lambda text, _: counted(text))
    rows = [t or "" for t in texts] * 10
    imatch.fingerprints(docs(spark, rows)).write.format("noop").mode("overwrite").save()
    assert 2 * len(rows) <= made.value <= 2 * len(rows) + 8 * 4 + 1  # texts, edited texts, the first of each range


# ---- 6 packing


def test_packing(spark, texts):
    got = packing.pack(docs(spark, texts).repartition(3), queries.vocabulary("word_bpe_49k.json"), capacity=512, keep_ids=True).cache()
    encode, want = whole("word_bpe_49k.json"), []
    for i, t in enumerate(texts):
        ids = [*encode(t), 1]
        want += [(i, k, at, len(ids[at : at + 512]), crc(ids[at : at + 512])) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(want)
    by = {}
    for r in got.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(w[3] for w in want)
    assert len(by) <= 1.05 * -(-total // 512) + 1
    assert packing.sequences(got).agg(F.sum(F.length("ids"))).head()[0] == 2 * total
    assert packing.pack(docs(spark, []), queries.vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    pick = [lambda: rng.randint(1, 400), lambda: rng.choice([134, 201, 100, 70]), lambda: min(400, int(rng.lognormvariate(4, 1)) + 1), lambda: 130][seed]
    counts = {}
    for _ in range(2000):
        n = pick()
        counts[n] = counts.get(n, 0) + 1
    bins = packing.best_plan(counts, 400)
    got = {}
    for k, slots in bins:
        assert sum(n * e for n, e in slots) <= 400
        for n, e in slots:
            got[n] = got.get(n, 0) + k * e
    assert got == counts


# ---- 7 co-training


def test_cotraining(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "morning", "walked", "quiet", "the"]) for _ in range(40))
    bad = lambda: " | ".join(rng.choice(["win$$$", "click###", "free%%%", "the"]) for _ in range(20))
    truth = [rng.random() < 0.7 for _ in range(400)]
    df = docs(spark, [good() if g else bad() for g in truth])
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(truth[:200])] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = cotraining.fit(df, labels)
    got = {r["doc_id"]: r["keep"] for r in cotraining.score(df, model).collect()}
    assert np.mean([got[i] == g for i, g in enumerate(truth)][200:]) > 0.97  # held out
    odd = docs(spark, [None, ""]).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    assert cotraining.score(odd, model).count() == 2
    kept = cotraining.kept(df, model)
    assert kept.columns == df.columns and kept.count() == sum(got.values())
    none = cotraining.fit(df, labels.limit(0))
    assert {r["score"] for r in cotraining.score(df, none).collect()} == {0.5} and cotraining.kept(df, none).count() == 400
    assert cotraining.score(docs(spark, []), cotraining.fit(docs(spark, []), labels)).count() == 0


def test_cotraining_is_fitted_off_the_driver(spark, monkeypatch):
    """Features of the sample stay with the executors; the rows of one id are
    taken in the same order however they lie."""
    rng = random.Random(6)
    truth = [rng.random() < 0.6 for _ in range(120)]
    df = docs(spark, [" ".join(rng.choice(["river", "stone", "the"] if g else ["win$$$", "free%%%", "the"]) for _ in range(30)) for g in truth])
    again = df.withColumn("text", F.lit("click### river"))
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(truth[:80])], "doc_id long, quality int")
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(df), name, lambda self: pytest.fail("the sample went to the driver"))
    a, b = (cotraining.fit(x, labels) for x in (df.unionByName(again), again.unionByName(df)))
    assert np.array_equal(a.text, b.text) and np.array_equal(a.meta, b.meta) and a.scales == b.scales and a.text.any()


def test_workers_keep_one_bounded_memory():
    """What a Python worker gathers over a stage is bounded, and the next stage's takes its place."""
    from tidemark.llm.encoding import encoder

    path = queries.vocabulary("word_bpe_49k.json")
    shared._REMEMBERED.clear()
    cotraining.content("one two")
    enc = encoder(path)
    assert list(shared._REMEMBERED) == [path] and encoder(path) is enc
    cotraining.content("one two")
    assert len(shared._REMEMBERED) == 1
    rows = [" ".join(f"{'abcdefghij'[k % 10]}{i * 997 + k}" for k in range(1000)) + " common words, here." for i in range(300)]
    found = [cotraining.content(t) for t in rows]
    kept = shared._REMEMBERED["buckets"]
    assert len(kept) + len(kept.older) <= 2 * kept.most <= 200_000 and b"common" in kept
    assert all(np.array_equal(x, y) for a, b in zip(found[:3], map(cotraining.content, rows[:3])) for x, y in zip(a, b, strict=True))
    enc = type(enc)(path, most=2000)
    assert enc.encode(rows[:20]) == [np.asarray(whole("word_bpe_49k.json")(t), enc.dtype).tobytes() for t in rows[:20]]
    assert len(enc.words) + len(enc.older_words) <= 2 * (enc.most + 1003) and "common" in enc.words


def test_batches_are_taken_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    got = list(shared.parts(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in got] == [256, 256, 256, 232, 0] and [x for b in got for x in b.column(0).to_pylist()] == list(range(1000))


# ---- 8 nearest neighbours


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) if c is not None else None for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "part", "qc", "low", "rank")})


def test_search_is_exact_on_few(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[40:60] = x[20]  # ties
    rows = [*x, None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0]]
    got = {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = x.astype(float)
    for q in range(0, 300, 20):
        s = (v * v[q]).sum(1)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [g[1] for g in sorted(got[q])] == best and [g[0] for g in sorted(got[q])] == list(range(1, 21))
        assert np.allclose([g[2] for g in sorted(got[q])], s[best], rtol=0, atol=1e-12)
    assert set(got) == set(range(0, 300, 20))
    assert ann.search(vectors(spark, [[1.0, 2.0], [2.0, 1.0], [3.0, 1.0]]), F.col("vec_id") == 0).count() == 2
    assert ann.search(vectors(spark, [[1.0]]).limit(0), F.col("vec_id") == 0).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16)) * 2
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    got = ann.search(vectors(spark, x), F.col("vec_id") % 20 == 0, sample=1500, per_part=200, cell=128).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(found[q] & set(np.argsort(-s[q])[:20])) / 20 for q in range(0, 3000, 20)])
    assert recall >= 0.9 and all(len(f) == 20 for f in found.values())


# ---- 9 mixing


def test_search_recall_of_production_parameters(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    rows = table.toPandas()
    x = np.array([np.asarray(e, float) for e in rows["embedding"]])
    hits = 0
    asked = rows.index[rows["vec_id"] % 20 == 0]
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        best = set(rows["vec_id"].to_numpy()[np.lexsort((rows["vec_id"], -s))[:20]])
        hits += len(best & set(got.loc[got["query_id"] == rows["vec_id"][i], "vec_id"]))
    assert len(got) == 20 * len(asked) and hits / len(got) >= 0.9
    few = np.array([r[0] for r in table.select("embedding").limit(2000).collect()], float)
    assert ann.fitted(few, len(few), 1024, 0.95)[1] > 1  # the learned path


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([300 * 5 / 8, 300 * 2 / 8, 300 / 8])
    t = mixing.targets([10, 500, 500])
    assert t[0] == 30 and sum(t) == pytest.approx(1010) and t[1] == pytest.approx(980 * 2 / 3)
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 7).tolist()) == list(range(n))


def test_mix(spark, texts):
    rng = random.Random(1)
    many = [*texts, *(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 300))) for _ in range(200))]
    df = docs(spark, many).repartition(3)
    run = lambda: sorted(tuple(r) for r in mixing.Mix(df, shared.Scratch(spark, "m"), block=16, shard_slots=200).taken().collect())
    got = run()
    assert got == run() and [g[0] for g in got] == list(range(len(many)))
    size = [len((t or "").encode().split()) for t in many]
    assert [g[1] for g in got] == size
    names = ["b", "a", None, "c"]
    per = {s: sum(size[i] for i in range(len(many)) if names[i % 4] == s) for s in names}
    goal = dict(zip(["a", "b", "c", None], mixing.targets([per[s] for s in ("a", "b", "c", None)]), strict=True))
    for s in names:
        rows = [g for g in got if names[g[0] % 4] == s]
        assert all(r[2] == per[s] and r[3] == pytest.approx(goal[s]) and r[4] <= 3 * r[1] for r in rows)
        assert sum(r[4] for r in rows) == pytest.approx(goal[s], rel=0.05)
    mixed = mixing.mixed_documents(df, shared.Scratch(spark, "m"), block=16).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    assert sum(len(r["text"].encode().split()) for r in mixed) == pytest.approx(sum(goal.values()), rel=0.05)
    assert mixing.Mix(docs(spark, []), shared.Scratch(spark, "m")).taken().count() == 0
    assert mixing.mixed_documents(docs(spark, [None, ""]), shared.Scratch(spark, "m")).count() == 0


def test_mix_by_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 400))) for _ in range(300))]
    names = ["b", "a", None, "c"]
    mix = mixing.Mix(docs(spark, texts).repartition(3), shared.Scratch(spark, "m"), block=16, shard_slots=100)
    slots = [tuple(r) for r in mix.slots.collect()]
    order = ["a", "b", "c", None]
    words = {s: [i for i in range(len(texts)) if names[i % 4] == s for _ in (texts[i] or "").split()] for s in order}  # the document of each word
    taken = dict.fromkeys(range(len(texts)), 0)
    for _, source, _, block in slots:
        for i in words[order[source]][block * 16 : block * 16 + 16]:
            taken[i] += 1
    assert {r["doc_id"]: r["taken"] for r in mix.taken().collect()} == taken
    # every slot of a source once, each block once a pass, totals to a slot
    goals = mixing.targets([len(words[s]) for s in order])
    for k, s in enumerate(order):
        own = sorted((slot, block) for _, source, slot, block in slots if source == k)
        n = -(-len(words[s]) // 16)
        assert [x[0] for x in own] == list(range(len(own)))
        assert abs(len(own) - goals[k] * n / len(words[s])) < 1.01
        for turn in range(0, len(own), n):
            assert len({b for _, b in own[turn : turn + n]}) == len(own[turn : turn + n])
    # shards are drawn, not dealt
    drawn = {}
    for shard, source, *_ in slots:
        drawn.setdefault(shard, [0] * 4)[source] += 1
    share = np.array(mixing.whole(np.array([g * -(-len(words[s]) // 16) / len(words[s]) for g, s in zip(goals, order, strict=True)]), np.full(4, 10**9)), float)
    share /= share.sum()
    even = sum(all(abs(c - 100 * p) < 1 for c, p in zip(v, share, strict=True)) for v in drawn.values())
    assert even < len(drawn) / 2


def test_mixed_documents_of_one_row_many_times(spark):
    same = docs(spark, ["a b c d e f g h"] * 40 + ["x y"] * 3).withColumns({"doc_id": F.lit(5).cast("long"), "source": F.lit("s")})
    mixed = mixing.mixed_documents(same.repartition(5), shared.Scratch(spark, "m"), block=4).collect()
    assert sum(len(r["text"].split()) for r in mixed) == 326


# ---- 10 SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    rng = random.Random(4)
    base = [t for t in texts if t and len(t) > 600]
    more = [*texts]
    for _ in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "edit"
        more.append(" ".join(w))
    fp = np.array([brute_fingerprint(t) for t in more], np.uint64)
    root = list(range(len(more)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(more)):
        for j in range(i):
            if np.bitwise_count(fp[i] ^ fp[j]) <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, more).repartition(3)).collect()}
    assert got == {i: (f"{int(fp[i]):016x}", find(i)) for i in range(len(more))}
    assert simhash.one_of_each(docs(spark, more)).count() == len({find(i) for i in range(len(more))})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    null = docs(spark, ["", ""]).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["component_id"] for r in simhash.near_duplicates(null).collect()} == {None}


def bits_apart(monkeypatch, prints):
    """Fingerprints as given for each text."""
    def rows(docs, *_):
        to = F.create_map(*[F.lit(x) for kv in prints.items() for x in kv])
        return docs.select(F.col("doc_id").cast("long"), to[F.col("text")].cast("long").alias("fp"), F.xxhash64("text").alias("th"))
    monkeypatch.setattr(simhash, "fingerprints", rows)


def test_null_ids_link(spark, monkeypatch):
    bits_apart(monkeypatch, {"a": 0b0, "near a": 0b11, "far": 0b1111, "x": 31 << 40, "y": 0xFF << 20, "near y": 0x7F << 20})
    rows = [(7, "a"), (None, "near a"), (3, "far"), (-5, "x"), (None, "y"), (None, "near y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the null id is near a and bridges 7 and 3; y's group has no id
    assert sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got), key=str) == sorted([(7, 0, 3), (None, 3, 3), (3, 15, 3), (-5, 31 << 40, -5), (None, 0xFF << 20, None), (None, 0x7F << 20, None)], key=str)


def test_one_of_each_of_odd_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, b), (5, c), (5, d), (4, d), (None, e), (None, e)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (1, b), (5, c), (4, d), (None, e)], key=str)


def test_large_cells_are_dealt_anew(spark):
    rng = np.random.default_rng(3)
    v = np.full(400, rng.integers(0, 2**63), np.uint64)
    for _ in range(3):
        v ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    v = np.unique(np.concatenate([v, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64))], "fp long, node long")
    want = simhash.groups(v, 2)
    for most in (8, 1 << 14):
        scratch = shared.Scratch(spark, "s")
        roots = {r["u"]: r["root"] for r in components.components(simhash.links(fps, 2, scratch, most), scratch).collect()}
        assert [roots.get(i, i) for i in range(len(v))] == want.tolist()


def test_trie_pairs():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 300)]
    for _ in range(2):
        v ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    v = np.unique(v)
    got = {tuple(sorted(p)) for x, y in simhash.trie_pairs(v, 2) for p in zip(x.tolist(), y.tolist(), strict=True)}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    assert got == {(j, i) for i in range(len(v)) for j in range(i) if near[i, j]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), shared.Scratch(spark, "c")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{100 + k: 100 for k in range(1, 60)}, 201: 200}


# ---- near-duplicates by shingles


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_heads(texts):
    sets, root = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def test_one_of_each_by_shingles(spark, texts):
    import corpus_pipeline

    rng = random.Random(9)
    base = [t for t in texts if t and len(t) > 300][:12]
    more = [*texts, *(" ".join(map(str, range(k, k + 100))) for k in range(0, 60, 6))]  # a chain of links
    for t in base * 6:
        w = t.split()
        for _ in range(rng.randint(1, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        more.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    rng.shuffle(more)
    df = docs(spark, more)
    want = brute_heads(more)
    got = shingles.one_of_each(df.repartition(3))
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    assert shingles.one_of_each(docs(spark, [])).count() == 0
    null = docs(spark, [None, "", *base[:3], base[0] + " end"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert shingles.one_of_each(null.unionByName(null)).count() == 4


def test_prints_link_directly(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, 300)]
    for _ in range(4):
        v ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    v = rng.permutation(np.unique(v))
    fps = spark.createDataFrame([(int(x), i) for i, x in enumerate(v.view(np.int64))], "fp long, node long")
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = {i: int(np.flatnonzero(near[i])[0]) for i in range(len(v)) if near[i, :i].any()}
    for most in (8, 1 << 14):
        found = simhash.links(fps, 3, shared.Scratch(spark, "s"), most, direct=True).groupBy("u").agg(F.min("v").alias("v"))
        assert {r["u"]: r["v"] for r in found.collect()} == want


def test_near_dedup_goes_through_the_trie(spark, texts, monkeypatch):
    import corpus_pipeline

    rng = random.Random(12)
    base, rows = [t for t in texts if t and len(t) > 600][:10], []
    for t in base:
        w = t.split()
        rows += [" ".join(w), " ".join([*w, "end"]), " ".join(w[:-1])]
    rng.shuffle(rows)
    seen, links = [], simhash.links

    def noted(fps, *args, **kw):
        found = links(fps, *args, **kw)
        seen.append((fps.count(), found.count()))
        return found

    monkeypatch.setattr(shingles, "links", noted, raising=False)
    got = corpus_pipeline.near_dedup(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_heads(rows)
    assert seen and seen[0][0] > len(base) and seen[0][1] >= len(base)  # prints of near copies meet there


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    before = given
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert out.columns == given.columns
        rows = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert rows and rows <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            assert len(good - rows) <= 0.02 * len(good) and len(bad & rows) <= 0.1 * len(bad)
        if name == "line_dedup":
            texts = [r["text"] for r in before.orderBy("doc_id").select("text").collect()]
            want = [t for t in brute_lines(texts)]
            assert [r["text"] for r in out.orderBy("doc_id").select("text").collect()] == [w for w, t in zip(want, texts, strict=True) if w == t or (w or "").split()]
        if name == "near_dedup":
            left = np.array([brute_fingerprint(r["text"]) for r in out.collect()], np.uint64)
            assert (np.bitwise_count(left[:, None] ^ left[None, :]) <= 2).sum() == len(left)
        before = out
