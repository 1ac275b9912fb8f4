"""Clusters, training data and streams on small tables; greedy grouping against a plain walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import clustering, entries, training
from faultline.sources import requests, tables
from faultline.streaming import intake


def walk(sets, threshold):
    """Each set's first earlier one that is like it, followed to the end."""
    like = lambda x, y: round(len(x & y) / (len(x) * len(y)) ** 0.5, 6) >= threshold(min(len(x), len(y)))
    up = [next((i for i in range(j) if like(sets[i], s)), j) for j, s in enumerate(sets)]
    for j in range(len(up)):
        while up[up[j]] != up[j]:
            up[j] = up[up[j]]
    return up


@pytest.mark.parametrize("block", [1000, 4])
def test_greedy_groups_match_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = random.Random(3)
    items, every = [], {}
    for g in range(12):
        sets = [{f"w{rng.randrange(8)}" for _ in range(rng.randint(1, 8))} for _ in range(12)]
        items += [(g, k, sorted(s)) for k, s in enumerate(sets)]
        every[g] = sets
    sizes = spark.range(1, 9).select("id", S.adaptive_threshold(F.col("id"), 0.7).alias("t")).collect()
    threshold = {r["id"]: r["t"] for r in sizes}
    df = spark.createDataFrame(items, "grp long, idx long, tokens array<string>")
    got = {(r["grp"], r["idx"]): r["root"] for r in clustering.similarity_groups(df, 0.7).collect()}
    if block == 1000:
        assert got == {(g, k): r for g, sets in every.items() for k, r in enumerate(walk(sets, threshold.get))}
    else:  # only block 0 and the own block are looked at
        assert all(got[g, got[g, k]] == got[g, k] and (got[g, k] // 4 in (0, k // 4)) for g, k in got)


def test_clusters_of_messages(spark):
    texts = ["db connection lost on node alpha now", "db connection lost on node alpha now", "cart item missing for user bob today", "db connection lost on node beta now", ""]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "grp long, idx long, text string")
    got = {r["idx"]: r["cluster"] for r in clustering.find_clusters(df, 0.95).collect()}
    assert got[0] == got[1] and got[2] != got[0] and len(got) == 5


def test_cluster_ids_are_stable(spark):
    df = spark.createDataFrame([("a", 0, "db lost on node one"), ("a", 1, "db lost on node two"), ("b", 2, "db lost on node three")], "cluster string, idx long, text string")
    ids = dict(clustering.cluster_ids(df, True).collect())
    again = dict(clustering.cluster_ids(df.where("idx < 2"), True).collect())
    assert ids["a"] == again["a"] != ids["b"] and ids["a"] % 10 == 1


def test_acceptance():
    better = training.compare([0.8, 0.82, 0.81, 0.79], [0.5, 0.52, 0.49, 0.5])
    assert better.accepted and better.p_value < 0.001
    assert not training.compare([0.3, 0.31], [0.1, 0.12]).accepted
    same = training.compare([0.5, 0.6, 0.7], [0.5, 0.6, 0.7])
    assert not same.accepted and same.p_value == pytest.approx(1.0)


def test_oversampling_fills_up(spark):
    rows = spark.createDataFrame([(float(k), float(k * k), int(k < 3)) for k in range(20)], "a double, b double, target int")
    out = training.oversampled(rows, ["a", "b"])
    assert out.where("target = 1").count() / out.count() >= 0.39
    assert training.oversampled(rows.where("target = 0"), ["a", "b"]).count() == 17


def test_requests(spark):
    raw = spark.createDataFrame([(json.dumps({"launchId": 1, "project": 2, "testItems": [{"testItemId": 5, "logs": [{"logId": 7, "message": "m"}]}]}),), ("{no json",), (None,)], "value string")
    good, bad = requests.parse(raw, requests.LAUNCH, "value")
    assert [tuple(r) for r in requests.log_rows(good).select("launch_id", "test_item_id", "log_id", "message").collect()] == [(1, 5, 7, "m")]
    assert bad.count() == 2


def test_items_and_objects(spark, tmp_path):
    items = spark.createDataFrame([(1, 10), (2, 20)], "project long, test_item_id long")
    tables.write_items(items, f"{tmp_path}/items")
    tables.write_items(spark.createDataFrame([(2, 21)], "project long, test_item_id long"), f"{tmp_path}/items")
    assert [r["test_item_id"] for r in tables.scan(spark, f"{tmp_path}/items", 1).collect()] == [10]
    assert [r["test_item_id"] for r in tables.scan(spark, f"{tmp_path}/items", 2, F.col("test_item_id") > 20).collect()] == [21]
    store = tables.ObjectStore(spark, f"{tmp_path}/objects")
    assert store.names(3) == []
    store.put(3, "a/b.json", {"x": [1]})
    assert store.exists(3, "a/b.json") and store.get(3, "a/b.json") == {"x": [1]} and store.names(3) == ["a/b.json"]
    assert store.remove(3) and store.names(3) == []


def test_stream_of_requests(spark, tmp_path):
    rows = spark.createDataFrame([("index", 2, 1, "b"), ("index", 1, 2, "a"), ("train_models", 3, 3, "t")], "route string, priority long, number long, body string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    handled = intake.process(intake.routed(stream, False), {"index": lambda b: b.select("number", F.upper("body").alias("reply"))}, f"{tmp_path}/out", f"{tmp_path}/cp")
    handled.awaitTermination()
    assert sorted(r["reply"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B"]


def test_failed_handlers_run_again_and_answer(spark, tmp_path):
    rows = spark.createDataFrame([("index", 1, 1, "c-1"), ("index", 2, 2, "c-2"), ("clean", 1, 3, "c-3"), ("item_remove", 1, 4, "c-4")], "route string, priority long, number long, correlation_id string")
    rows.write.parquet(f"{tmp_path}/in")
    tries = {"index": 0, "item_remove": 0}

    def flaky(batch):
        tries["index"] += 1
        if tries["index"] < 3:
            raise RuntimeError("not yet")
        return batch.select("number", F.lit("done").alias("reply"))

    def hopeless(batch):
        tries["item_remove"] += 1
        raise RuntimeError("conflict, but no document was found")

    handlers = {"index": flaky, "clean": lambda b: b.select("number", F.lit("ok").alias("reply")), "item_remove": hopeless}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    intake.process(stream, handlers, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = lambda route: [r.asDict() for r in spark.read.parquet(f"{tmp_path}/out/route={route}").collect()]
    assert sorted((r["correlation_id"], r["reply"], r["attempt"]) for r in out("index")) == [("c-1", "done", 3), ("c-2", "done", 3)]
    assert [(r["correlation_id"], r["reply"]) for r in out("clean")] == [("c-3", "ok")]
    assert [(r["correlation_id"], r["reply"], "no document" in r["error"]) for r in out("item_remove")] == [("c-4", None, True)] and tries["item_remove"] == 1


def test_training_keeps_only_what_is_better(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(240)], "id long, f_0 double, f_1 double, target int")
    told = entries.train_analysis(rows, ["f_0", "f_1", "f_9"], None, f"{tmp_path}/model", seeds=[1, 2], trees=3)
    assert told["saved"] and told["new_f1"] > 0.9 and told["baseline_f1"] == 0.0
    from pyspark.ml import PipelineModel

    baseline = PipelineModel.load(f"{tmp_path}/model")
    again = entries.train_analysis(rows, ["f_0", "f_1", "f_9"], baseline, f"{tmp_path}/other", seeds=[1, 2], trees=3)
    assert not again["saved"] and again["baseline_f1"] > 0.9
    few = entries.train_analysis(rows.where("target = 0"), ["f_0"], None, f"{tmp_path}/none", seeds=[1])
    assert few["bad_data"] and not few["saved"]


def test_a_stored_cluster_is_taken_over(spark):
    from faultline.operators import answers

    shape = "project long, launch_id long, test_item_id long, log_id long, message string, found_exceptions string, potential_status_codes string"
    text = "connection to database lost on node alpha while saving order"
    rows = [(1, 5, 50, 1, text, "E", ""), (1, 5, 51, 2, text, "E", ""), (1, 5, 52, 3, "cart item is missing for user bob today", "", ""), (1, 5, 53, 4, text, "Other", "")]
    old = [(1, 4, 40, 9, text, "E", "", 771, text), (1, 4, 41, 8, text, "E", "", 0, ""), (1, 5, 50, 10, text, "E", "", 991, text)]
    found, updates = answers.clusters_of_launch(spark.createDataFrame(rows, shape), spark.createDataFrame(old, shape + ", cluster_id long, cluster_message string"))
    got = {tuple(r["log_ids"]): r for r in found.collect()}
    assert set(got) == {(1, 2), (3,), (4,)} and got[1, 2]["cluster_id"] == 771 and got[1, 2]["item_ids"] == [50, 51]
    assert got[4,]["cluster_id"] not in (771, 991) and updates.count() == 4
    redone, _ = answers.clusters_of_launch(spark.createDataFrame(rows, shape), spark.createDataFrame(old, shape + ", cluster_id long, cluster_message string"), for_update=True)
    assert {r["cluster_id"] for r in redone.collect() if 1 in r["log_ids"]} == {991}
