"""Queries on pairs look at every log: against pairs made one by one."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from faultline.operators import clustering, similarity, training
from faultline.plans import catalogue
from faultline.plans.logs import logs

from .test_catalogue import SF


def test_hits_match_brute_force(spark):
    errors = [r for r in logs(spark, SF).collect() if r["log_level"] >= 40000]
    want = {(a["log_id"], b["log_id"]) for a in errors for b in errors if a["test_case_hash"] == b["test_case_hash"] and a["test_item_id"] != b["test_item_id"]}
    assert {(r["req"], r["hit"]) for r in catalogue.queries()["ret_13_boosts"](spark, SF).collect()} == want


def test_pairs_are_the_hits_of_all_logs(spark):
    errors = [r for r in logs(spark, SF).collect() if r["log_level"] >= 40000]
    want = {(a["log_id"], b["log_id"], b["test_item_id"]) for a in errors for b in errors if a["test_case_hash"] == b["test_case_hash"] and a["test_item_id"] != b["test_item_id"]}
    features = [(r["req"], r["hit"]) for r in catalogue.queries()["fea_pair"](spark, SF).select("req", "hit").collect()]
    assert sorted(features) == sorted((req, hit) for req, hit, _ in want)
    best = [(r["req"], r["item"]) for r in catalogue.queries()["mlp_09_similarity"](spark, SF).select("req", "item").collect()]
    assert sorted(best) == sorted({(req, item) for req, _, item in want})


def plan_of(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_neighbours_are_shuffled_once_for_both_sides(spark):
    plan = plan_of(spark, "sim_02_cosine")
    assert plan.count("RepartitionByExpression") == 2
    assert "array_intersect(" in plan


def test_likeness_of_repeated_terms(spark):
    texts = ["cat cat dog", "cat dog dog dog", "cat cat dog", "bird", "", "the", "The"]
    rows = similarity.with_terms(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x", "t")
    got = {(r["i"], r["j"]): r["s"] for r in rows.alias("a").crossJoin(rows.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), similarity.similarity(F.col("a.t"), F.col("b.t"))["similarity"].alias("s")).collect()}

    def counts(text):
        words = [w for w in text.lower().split() if w != "the"]
        return collections.Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)])

    for (i, j), found in got.items():
        a, b = counts(texts[i]), counts(texts[j])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        want = round(sum(a[t] * b[t] for t in a) / norm, 6) if norm else float(not a and not b and texts[i] == texts[j] and texts[i] != "")
        assert found == want, (texts[i], texts[j])


@pytest.mark.parametrize("name", ["fea_pair", "mlp_09_similarity", "flt_23_positive"])
def test_likeness_is_computed_once_for_two_logs(spark, name):
    plan = plan_of(spark, name)
    assert "a_test_item_id" in plan and "array_intersect(" in plan
    assert name != "fea_pair" or "Window" not in plan


@pytest.mark.parametrize("name", ["req_search", "req_search_all"])
def test_pairs_of_a_search_are_not_joined_again(spark, name):
    assert plan_of(spark, name).count("Join Inner") == 2


def test_a_forest_is_trained_on_stored_tokens(spark):
    assert "regexp_extract_all" not in plan_of(spark, "mlp_03_defect_type")


def test_a_forest_never_makes_a_row_as_wide_as_its_vocabulary(spark):
    """Half of 4000 texts name one token; of 400 others each is in ten, and tells nothing."""
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("target"), F.when(F.col("id") % 2 == 1, F.array(F.lit("red"), F.concat(F.lit("x"), F.col("id") % 400))).otherwise(F.array(F.concat(F.lit("x"), F.col("id") % 400))).alias("tokens"))
    model = training.train_defect_type(rows, trees=20)
    assert not [s for s in model.stages if "RandomForest" in type(s).__name__]
    assert training.f1(model.transform(rows)) == 1.0
    assert training.f1(model.transform(rows.withColumn("target", 1 - F.col("target")))) == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 999])
def test_a_split_of_stored_rows_is_that_of_ranks(spark, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 5 < 4, F.col("id") % 5 % 2).alias("target"))
    split = {(r["id"], r["is_test"]) for r in training.stratified_split(rows).collect()}
    spread = training.spread_split(rows)
    assert {(r["id"], r["is_test"]) for r in spread.collect()} == split
    assert "_b" in spread._jdf.queryExecution().optimizedPlan().toString()


def _cosine(a, b):
    """Whether two sets are alike at 0.95; of short ones a word may be missing."""
    least = min(len(a), len(b))
    eased = (least - 1) / least if least else 0
    return bool(a and b) and round(len(a & b) / math.sqrt(len(a) * len(b)), 6) >= (min(0.95, round(eased, 4)) if eased >= 0.8 else 0.95)


def test_groups_of_like_sets_match_pairs_made_one_by_one(spark):
    common = [f"c{k}" for k in range(24)]
    sets = [(g, i, sorted({*common[: 3 + (7 * i + g) % 21], *([f"x{i % 5}"] if i % 3 else []), *([f"y{i}"] if i % 4 == 0 else [])})) for g in range(3) for i in range(60)]
    want = {}
    for g, i, t in sets:
        up = next((j for h, j, u in sets if h == g and j < i and _cosine(set(t), set(u))), i)
        want[g, i] = want.get((g, up), up)
    found = clustering.similarity_groups(spark.createDataFrame(sets, "grp int, idx int, tokens array<string>"), 0.95)
    assert {(r["grp"], r["idx"]): r["root"] for r in found.collect()} == want


def test_texts_of_two_tables_are_alike_as_in_clusters_of_the_two(spark):
    texts = [" ".join([f"w{k}" for k in range(n)] + tail) for n in (0, 1, 4, 8, 15, 24, 25) for tail in ([], ["p"], ["q"], ["p", "q"])]
    rows = [(1, t) for t in texts]
    got = {(r["left"], r["right"]) for r in clustering.like_texts(spark.createDataFrame(rows[::2], "grp int, same string"), spark.createDataFrame(rows, "grp int, same string")).collect()}
    pairs = [(f"{a}|{b}", i, t) for a in texts[::2] for b in texts for i, t in enumerate((a, b))]
    both = clustering.find_clusters(spark.createDataFrame(pairs, "grp string, idx int, text string")).groupBy("grp").agg(F.countDistinct("cluster").alias("n")).where("n = 1")
    assert {f"{a}|{b}" for a, b in got} == {r["grp"] for r in both.collect()}
