"""Text rules on strings of our own, and the facts that hold for them."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.functions import text as T
from faultline.operators import decide, prepare, similarity


def value(spark, rule, *texts):
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{k} string" for k in range(len(texts))))
    return df.select(rule(*[F.col(f"c{k}") for k in range(len(texts))])).first()[0]


@pytest.mark.parametrize(
    "rule, given, wanted",
    [
        (T.remove_starting_datetime, "2021-03-04 10:11:12.123 - start", "start"),
        (T.remove_starting_datetime, "[10:11:12] start", "start"),
        (T.remove_starting_level, "[ERROR] boom", "boom"),
        (T.remove_starting_level, "error boom", "error boom"),
        (T.remove_starting_thread_id, "4711 --- boom", "boom"),
        (T.remove_starting_thread_name, "[main] boom", "boom"),
        (T.delete_empty_lines, "a\n \n\nb\n", "a\nb"),
        (T.unify_line_endings, "a \t\r\nb\nc", "a\nb\nc"),
        (T.unify_spaces, "a  \t b \n  c", "a b\nc"),
        (T.remove_numbers, "a1 22 b", "a SPECIALNUMBER b"),
        (T.remove_bracketed, "a [b] (c) {d} e", "a    e"),
        (T.clean_html, "x\n<html><b>y</b>&amp;\n</html>\nz", "x\n  y  \n \nz".replace("\n \n", "\n").replace("  y  ", "  y  ")),
        (T.remove_uuids, "id 550e8400-e29b-41d4-a716-446655440000", "id SPECIALUUID"),
        (T.remove_hex, "at 0x00007f3a1b2c", "at SPECIALHEX"),
        (T.decode_urls, "a%20(b)", "a  b "),
        (T.decode_urls, "100% (sure)", "100% (sure)"),
        (T.remove_generated_parts, "at com.a.Outer$Inner.call(X)\n... 12 more", "at com.a.Outer.Inner.call(X)"),
        (T.unique_lines, "a\n a\nb\nfor documentation on this error please visit x", "a\nb"),
        (T.space_colons, "a:b", "a : b"),
        (T.remove_access_tokens, '"access_token": "abc"', '"access_token": "SPECIALTOKEN"'),
        (T.remove_credentials, "https://user:pass@host/x", "https://host/x"),
        (T.remove_credentials, "https://host/x@y", "https://host/x@y"),
        (T.only_numbers, "took 12 of 34.5 ms", "12 34.5"),
        (T.enrich_methods, "com.acme.Service.method failed", "com.acme.Service.method Service.method method  failed"),
        (T.enrich_exceptions, "com.acme.BadError", "com.acme.BadError acme.BadError BadError"),
        (T.readable, "SPECIALNUMBER rows", "[EXCLUDED NUMBER] rows"),
        (T.lower_issue_prefix, "PB001A", "pb001A"),
        (T.base_issue, "PB001", "pb"),
        (T.base_issue, "pb_custom", "pb_custom"),
    ],
)
def test_rules(spark, rule, given, wanted):
    assert value(spark, rule, given) == wanted


def test_lists(spark):
    assert value(spark, T.extract_urls, "see https://a.b/c?d and http://x.y/z") == ["https://a.b/c?d", "http://x.y/z"]
    assert value(spark, T.extract_paths, "in /var/log/x.log and C:\\a\\b.txt") == ["/var/log/x.log", "C:\\a\\b.txt"]
    assert value(spark, T.extract_params, "got 'a b' there") == ["a b"]
    assert value(spark, T.unique_status_codes, "status code: 409\nresponse status: 404") == ["409", "404"]
    assert value(spark, T.found_exceptions, "java.lang.IllegalStateException: x SomeError IOError") == ["java.lang.IllegalStateException", "SomeError"]
    assert value(spark, T.test_methods, "in com.a.CartTest.add and ui/x.spec.ts") == ["com.a.CartTest.add", "x.spec.ts"]
    assert value(spark, T.feature_range, "1-3, 5") == [1, 2, 3, 5]
    assert value(spark, T.split_words, "The cart. of A-b/c") == ["cart", "b", "c"]


def test_message_and_stack(spark):
    log = "Boom happened\nat com.acme.A.b(A.java:3)\nat com.acme.C.d(C.java:9)"
    assert value(spark, T.split_message_and_stack, log).asDict() == {"message": "Boom happened", "stack": "at com.acme.A.b(A.java:3)\nat com.acme.C.d(C.java:9)"}
    python = 'Traceback (most recent call last):\n  File "x.py", line 3, in f\n    g()\nValueError: bad'
    parts = value(spark, T.split_message_and_stack, python)
    assert parts["message"] == "ValueError: bad" and parts["stack"].startswith("Traceback")
    assert value(spark, T.split_message_and_stack, "one\ntwo").asDict() == {"message": "one\ntwo", "stack": ""}


def test_clustering_text(spark):
    assert value(spark, lambda m: T.message_for_clustering(m, -1, True), "Order 17 failed with status code: 500") == "Order SPECIALNUMBER failed status code 500"
    assert value(spark, lambda m: T.message_for_clustering(m, -1, True), "boom") == "boom error"
    assert value(spark, lambda m: T.message_for_clustering(m, -1, True), "") is None


def test_similarity(spark):
    pairs = [("a b c", "a b c", 1.0, False), ("", " ", 0.0, True), ("x", "", 0.0, False), ("the", "of", 0.0, False), ("the", "the", 1.0, False), ("red fox", "red dog", 0.333333, False)]
    df = spark.createDataFrame(pairs, "x string, y string, s double, e boolean")
    df = similarity.with_terms(similarity.with_terms(df, "x", "_x"), "y", "_y").select("s", "e", similarity.similarity(F.col("_x"), F.col("_y")).alias("r"))
    for row in df.collect():
        assert (row["r"]["similarity"], row["r"]["both_empty"]) == (row["s"], row["e"])


@pytest.mark.parametrize("texts, kept", [("aaa", [2]), ("aba", [1, 2]), ("abb", [0, 2]), ("abab", [2, 3]), ("ababa", [3, 4]), ("ababac", [3, 4, 5])])
def test_last_unique(spark, texts, kept):
    words = {"a": "alpha one", "b": "beta two", "c": "gamma three"}
    df = spark.createDataFrame([(1, k, words[c]) for k, c in enumerate(texts)], "grp long, idx int, text string")
    assert sorted(r["idx"] for r in similarity.last_unique(df, 0.95).collect()) == kept


def test_value_overlap(spark):
    assert round(value(spark, similarity.value_overlap, "1 2 3", "2 3 4"), 3) == 0.444
    assert value(spark, similarity.value_overlap, "", "a") == 0.0


def test_thresholds(spark):
    df = spark.createDataFrame([(0,), (4,), (5,), (20,)], "n int").select(S.adaptive_threshold(F.col("n"), 0.95))
    assert [r[0] for r in df.collect()] == [0.95, 0.95, 0.8, 0.95]


def test_selected_logs(spark):
    rows = [(1, k, 40000, m) for k, m in enumerate(["db timeout error one", "db timeout error one", "db timeout error one", "cart is empty", "   "])] + [(1, 9, 20000, "low level")]
    df = spark.createDataFrame(rows, "test_item_id long, log_id long, log_level int, message string")
    got = prepare.select_logs(df, most=0).orderBy("log_order").collect()
    assert [(r["log_id"], r["log_order"]) for r in got] == [(2, 0), (3, 1), (4, 2)]
    assert [r["log_id"] for r in prepare.select_logs(df, most=2).orderBy("log_order").collect()] == [3, 4]


def test_prepared_fields(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00 ERROR com.acme.BadException: order 12 failed with status code: 500 at https://a.b/c\nat com.acme.A.b(A.java:3)\nat com.acme.C.d(C.java:4)"), (2, None), (3, "")], "log_id long, message string")
    out = {r["log_id"]: r for r in prepare.prepare_logs(df).collect()}
    assert out[1]["found_exceptions"] == "com.acme.BadException" and out[1]["potential_status_codes"] == "500" and out[1]["urls"] == "https : //a.b/c".replace(" : ", ":")
    assert "SPECIALNUMBER" in out[1]["message"] and "A.java" not in out[1]["detected_message"]
    assert out[2]["message"] == "" and out[3]["message_lines"] == 0


def test_patterns_by_type(spark):
    rows = [("E1", "ab001")] * 10 + [("E1", "pb001")] + [("E1", "ti001")] * 2 + [("E2", "si001")] * 4
    df = spark.createDataFrame(rows, "exception string, issue_type string")
    assert [tuple(r) for r in decide.patterns(df).collect()] == [("E1", 13, 0.91, "ab")]
    assert [tuple(r) for r in decide.unlabelled_patterns(df).collect()] == [("E1", 13)]
