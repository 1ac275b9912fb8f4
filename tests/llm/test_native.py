import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from faultline.llm import ordering, quality
from faultline.llm.fingerprint import add_fingerprint, fingerprint_with_edits, likeness
from faultline.llm.quality import binomial_tail, quality_stats, quality_verdicts, risk_controlled_cutoffs
from faultline.llm.sharding import shard_by_bytes

from .fixtures import documents, empty, shingles, words


def test_edited_texts_and_likeness(spark):
    docs = documents(spark).dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -math.inf, r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"] if r["doc_id"] is not None else -math.inf: r for r in fingerprint_with_edits(docs).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(text, lower=False), shingles(other, lower=False)
            errors.append(abs(near - (len(a & b) / len(a | b) if a or b else 1.0)))
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.25


def test_fingerprints_of_few_and_no_rows(spark):
    assert fingerprint_with_edits(empty(spark)).count() == 0
    (one,) = fingerprint_with_edits(spark.createDataFrame([(4, "one two three")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0 and len(one["fingerprint"]) == 256
    twins = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert fingerprint_with_edits(twins).count() == 2


def test_likeness_of_words_shared_by_half(spark):
    a, b = " ".join(f"a{k}" for k in range(900)), " ".join(f"a{k}" if k < 600 else f"b{k}" for k in range(900))
    df = add_fingerprint(add_fingerprint(spark.createDataFrame([(a, b)], "x string, y string"), "x", "p"), "y", "q")
    near = df.select(likeness(F.col("p"), F.col("q"))).first()[0]
    assert abs(near - 596 / (896 + 300)) < 0.13


def stats(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = [False] * len(w)
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 500 else grams[(i + 1) % len(grams)] == g or g in grams[:i]:
            covered[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(covered)


def test_quality_counts_match_brute_force(spark):
    extra = spark.createDataFrame([(5000, "one two\nx # y\none two\n\n \none two\n<b>", "en", "s", 1)], documents(spark).schema)
    rows = quality_stats(documents(spark).unionByName(extra)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats(r["text"])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 40, 0.05), (7, 5000, 0.002), (40, 50000, 0.001), (0, 0, 0.1)]
    for k, n, rate in cases:
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), rate)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log(1 - rate)) for j in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-6)


def test_cutoffs_keep_clean_rows(spark):
    rows = [(k, "en", k % 1000 / 1000, True) for k in range(20000)] + [(k, "de", 0.5, True) for k in range(30)]
    found = risk_controlled_cutoffs(spark.createDataFrame(rows, "id long, lang string, score double, clean boolean"), "lang", ["score"], 0.01).collect()
    assert [r["stratum"] for r in found] == ["en"]  # thirty rows prove nothing
    assert found[0]["n_rejected"] / found[0]["n_clean"] <= 0.01 and found[0]["cutoff"] < 0.999


def test_rules_share_one_budget(spark):
    rows = [("en", 0.0, k / 2000, True) for k in range(2000)] + [("de", 0.0, k / 500, True) for k in range(500)]
    holdout = spark.createDataFrame(rows, "lang string, flat double, steep double, clean boolean")
    found = {(r["stratum"], r["rule"]): r for r in risk_controlled_cutoffs(holdout, "lang", ["flat", "steep"]).collect()}
    # 2000 rows grant 4 or 5 blocks at 0.5 %, 500 rows none: 0.995 ** 500 > 0.05.
    blocks = max(k for k in range(1, 11) if sum(math.comb(2000, j) * 0.005**j * 0.995 ** (2000 - j) for j in range(k)) <= 0.05)
    assert set(found) == {("en", "flat"), ("en", "steep")}
    assert found["en", "flat"]["cutoff"] == 0.0 and found["en", "flat"]["n_rejected"] == 0
    assert found["en", "steep"]["n_rejected"] <= blocks // 2 - 1
    assert all(r["tail"] <= 0.05 for r in found.values())


def test_verdicts_without_labels_and_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_verdicts(documents(spark), labels)
    assert out.where("kept = base_failed").count() == 0 and out.count() == documents(spark).count()
    assert quality_verdicts(empty(spark), labels).count() == 0


def test_clashing_columns_are_replaced(spark):
    labels = spark.createDataFrame([(None, None, None), (3, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark).withColumnRenamed("source", "kept").withColumnRenamed("n_chars", "n_words")
    out = quality_verdicts(docs, labels)
    assert out.columns.count("kept") == out.columns.count("n_words") == 1 and out.count() == docs.count()
    clash = documents(spark).withColumnRenamed("source", "size").withColumnRenamed("lang", "shard")
    assert shard_by_bytes(clash).count() == fingerprint_with_edits(clash.withColumnRenamed("size", "packed")).count()


def test_shards(spark):
    docs = documents(spark)
    rows = shard_by_bytes(docs, 7).collect()
    sizes = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sizes
    total, at = sum(s for _, s, _ in sizes), 0
    for shard in sorted({r["shard"] for r in rows}):
        own = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start_byte"] == at and (2 * at + r["size"]) * 7 // (2 * total) == shard
            at += r["size"]
    assert shard_by_bytes(empty(spark)).count() == 0


def test_buckets_follow_the_order_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(ordering, "QUANTILES", 8)
    rows = [(5, f"t{k}") for k in range(300)] + [(k, "x") for k in range(400)] + [(None, "n"), (-(2**62), "a"), (2**62, "b")] + [(7, "same")] * 20
    df = spark.createDataFrame(rows, "id long, text string").withColumn("th", F.xxhash64("text"))
    for per_bucket in (1, 40, 10**6):
        bucket = ordering.range_buckets(df.select("id", "th"), "id", F.col("th"), rows_per_bucket=per_bucket)
        got = sorted(((r["id"] if r["id"] is not None else -(2**63), r["th"]), r["b"]) for r in df.withColumn("b", bucket).collect())
        assert [b for _, b in got] == sorted(b for _, b in got)
        sizes = [sum(1 for _, b in got if b == x) for x in {b for _, b in got}]
        assert len(sizes) == 1 if per_bucket == 10**6 else max(sizes) <= 150


def test_binomial_tail_is_exact(spark):
    cases = [(0, 600, 0.005), (3, 1000, 0.005), (20, 5000, 0.005), (4, 9, 0.3), (180, 40000, 0.005)]
    for k, n, rate in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate)) for j in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), rate).alias("p")).first()["p"]
        assert abs(got / want - 1) < 1e-7


def test_a_rule_rejects_within_its_risk(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(2400):
        poor = k % 6 == 0
        text = " ".join(rng.choices(words, k=40)) + (" ### $$$ %%%" if poor else "")
        rows.append((k, text, "en", "clash"))
        if k < 1800:
            labels.append((k, int(not poor)))
    labels += labels[:50]  # labelled twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, symbol_share string")
    out = quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in out if r["doc_id"] >= 1800]
    assert all(r["failed_rules"] == ["symbol_share"] and not r["kept"] for r in held if r["doc_id"] % 6 == 0)
    clean = [r for r in held if r["doc_id"] % 6]
    assert sum(not r["kept"] for r in clean) <= 0.02 * len(clean)
