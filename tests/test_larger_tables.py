"""What only larger tables hold: against the oracles, on small tables made to hold it."""

import datetime

import duckdb
import pytest

from faultline.operators import answers, similarity
from faultline.plans import catalogue

from .test_catalogue import SF, plain


@pytest.fixture
def equals_oracle(spark, tmp_path):
    """Compares a query with its oracle on events of (event_id, user_id, event_type)."""

    def run(name, events):
        start = datetime.datetime(2024, 1, 1)
        rows = [(e, start + datetime.timedelta(hours=7 * k), u, kind, 1.0, "") for k, (e, u, kind) in enumerate(events)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        df = catalogue.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        cursor = connection.execute(catalogue.oracles()[name])
        names = [d[0] for d in cursor.description]
        assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
        return got

    return run


def test_history_of_a_test_case_with_one_type(equals_oracle):
    assert len(equals_oracle("win_09_history", [(0, 0, "error"), (3, 0, "error"), (1, 1, "error"), (2, 1, "error")])) == 2


def test_an_analysis_answers_all_items(spark):
    fields = "0 as project, id as req_item, id as req, -id as item, id + 100000 as hit, 0 as hit_pos, 'pb001' as issue_type, 40000 as log_level, 9 as length, 0.9D as probability, 1 as label"
    predictions = spark.range(4100).selectExpr(*fields.split(", "))
    assert answers.analyze(predictions).count() == 4100
    assert answers.analyze(predictions, 7).count() == 7


def test_texts_are_not_read_again_for_each_weight(spark):
    texts = spark.createDataFrame([(1, 0, "order one failed"), (1, 1, "order one failed"), (1, 2, ""), (2, 0, "alone")], "grp int, idx int, text string")
    kept = similarity.last_unique(texts, 0.95)
    assert sorted((r["grp"], r["idx"]) for r in kept.collect()) == [(1, 1), (1, 2), (2, 0)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3


@pytest.mark.parametrize("name", ["sim_05_last_unique", "pre_12_selected_logs", "pre_12_items", "sim_08_request_messages", "ret_01_more_like_this"])
def test_terms_of_texts_are_never_collected_in_the_driver(spark, name):
    """Spark takes the terms for as small as the files, and would broadcast them."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "term" in x]
    assert [x for x in plan.splitlines() if "SortMergeJoin" in x and "term" in x]


def test_terms_of_texts_are_small(spark):
    rows = similarity.with_terms(spark.createDataFrame([("a a b",)], "x string"), "x", "t")
    assert rows.select("t.terms").schema["terms"].dataType.simpleString() == "array<bigint>"


def test_a_search_shuffles_messages_and_what_it_tells(spark):
    """An item of two launches is told by its best log alone; pairs that tell nothing are not shuffled."""
    requests = spark.createDataFrame([(1, 0, 1, [1, 2])], "req long, project long, item_id long, launches array<long>")
    messages = spark.createDataFrame([(1, 0, "order broken status code: 500")], "req long, idx long, message string")
    logs = [
        (1, 7, 70, "order broken status code: 404"), (2, 7, 71, "order broken hard today status code: 500"),
        (1, 8, 80, "order broken status code: 500"), (2, 9, 90, "order broken hard today status code: 500"), (2, 5, 50, "order broken status code: 404"),
    ]
    stored = spark.createDataFrame([(0, launch, item, "ti001", log, log, text) for launch, item, log, text in logs], "project long, launch_id long, test_item_id long, issue_type string, log_id long, log_order long, message string")
    found = answers.search_logs(requests, messages, stored, least=0.3)
    assert [(r["item"], r["log_id"], r["place"]) for r in found.orderBy("place").collect()] == [(8, 80, 0), (9, 90, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
