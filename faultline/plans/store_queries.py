"""Queries of the item store, small rules, entries and delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.functions import text as T
from faultline.operators import answers as A
from faultline.operators import clustering as C
from faultline.operators import decide, dml
from faultline.operators import entries as E
from faultline.operators import training as TR
from faultline.plans import duck as D
from faultline.plans import search_queries as Q
from faultline.plans.item_queries import last_unique_sql
from faultline.plans import text_oracles as O
from faultline.plans.logs import ORACLE_LOGS, events, logs
from faultline.sources import tables
from faultline.streaming import intake

NOW = Q.NOW


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items with their logs nested."""
    rows = logs(spark, sf_dir)
    nested = F.array_sort(F.collect_list(F.struct("log_id", "log_level", "message", F.col("log_time").cast("string").alias("log_time"), (F.col("log_id") % 9).alias("cluster_id"))))
    first = [F.min(c).alias(c) for c in ("project", "launch_id", "launch_name", "issue_type")]
    return rows.groupBy("test_item_id").agg(*first, F.min(F.date_trunc("day", "log_time")).alias("launch_start_time"), nested.alias("logs")).withColumn("log_count", F.size("logs"))


_ITEMS = f"{ORACLE_LOGS}, items AS (SELECT test_item_id, min(project) AS project, min(launch_id) AS launch_id, min(launch_name) AS launch_name, min(issue_type) AS issue_type, min(date_trunc('day', log_time)) AS day, count(*) AS n FROM logs GROUP BY 1)"


def flt_02_nested_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where(F.exists("logs", lambda x: x["log_level"] >= 40000)).select("test_item_id")


def flt_08_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where(F.col("launch_id").isin(3, 5, 8)).select("log_id", "launch_id")


def _with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the issue types that their logs say, as a history in log order."""
    entry = F.struct("log_id", F.concat(F.lower("issue_type"), (F.col("log_id") % 3).cast("string")).alias("issue_type"))
    rows = logs(spark, sf_dir)
    return rows.groupBy("test_item_id").agg(F.array_sort(F.collect_list(F.when(F.col("issue_type").isNotNull(), entry))).alias("issue_history"), F.array_sort(F.collect_list(F.struct("log_id", "message"))).alias("logs"))


def flt_21_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_history(spark, sf_dir).where(F.exists("issue_history", lambda h: h["issue_type"].isNotNull())).select("test_item_id")


def flt_23_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.best_predictions(Q._similar_pairs(spark, sf_dir).where("probability >= 0.5"), 0.5).select("req", "item", "hit")


def ret_07_cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each launch and cluster the first item of the launch with a log in it."""
    held = _items(spark, sf_dir).where("issue_type IS NOT NULL").select("launch_id", "test_item_id", F.explode(F.array_distinct("logs.cluster_id")).alias("cluster_id"))
    return held.where("cluster_id <> 0").groupBy("launch_id", "cluster_id").agg(F.min("test_item_id").alias("test_item_id"))


def _typed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._hits(spark, sf_dir).where("issue_type IS NOT NULL").select("req_item", "item", F.lower("issue_type").alias("issue_type"), F.when(F.col("req_item") % 3 == 0, "pb001").otherwise("nd001").alias("positive_type")).distinct()


def ret_09_other_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _typed_hits(spark, sf_dir)
    return E.with_other_types(hits.where("issue_type = positive_type"), hits).select("req_item", "item", "issue_type")


def ret_10_pattern_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the known types, the latest launch first."""
    rows = _items(spark, sf_dir).where(F.lower(F.substring("issue_type", 1, 2)).isin("ab", "pb", "si"))
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.col("launch_start_time").desc(), "test_item_id"))
    return rows.select("project", "test_item_id", place.alias("place"))


def agg_03_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._hits(spark, sf_dir).groupBy("req_item").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("req").alias("f_66"))


def agg_11_error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by the exceptions and codes that they name, with the first of each group."""
    rows = logs(spark, sf_dir).where("log_level >= 40000")
    key = C.error_key(T.joined(T.found_exceptions(F.col("message")), " "), T.joined(T.status_codes(F.col("message")), " "))
    return rows.groupBy("project", "launch_id", key.alias("key")).agg(F.min("log_id").alias("first"), F.count(F.lit(1)).alias("n"))


_ERROR_GROUPS = f"""{ORACLE_LOGS},
keyed AS (SELECT *, array_to_string(list_sort({D.exceptions('message')}), ' ') || '|' || array_to_string(list_sort({O.status_codes('message')}), ' ') AS key FROM logs WHERE log_level >= 40000)
SELECT project, launch_id, key, min(log_id) AS first, count(*) AS n FROM keyed GROUP BY ALL"""


def agg_18_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.defect_entries(_with_history(spark, sf_dir)).where("is_positive").groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def trn_04_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.defect_entries(_with_history(spark, sf_dir)).select("test_item_id", "log_id", "issue_type", "is_positive")


def set_03_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stored before (those of the first launches) with those of new logs."""
    words = logs(spark, sf_dir).select("project", "launch_id", F.explode(T.split_words(F.col("message"))).alias("word"))
    old, new = words.where("launch_id < 10").drop("launch_id").distinct(), words.where("launch_id >= 10").drop("launch_id")
    return old.union(new).distinct()


def fea_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each issue type, share of the request's logs that found the best item, and how many logs found anything."""
    hits = decide.normalised(Q._hits(spark, sf_dir).where("issue_type IS NOT NULL"))
    rows = decide.identity_features(hits, "issue_type").select("req_item", "issue_type", "f_1", F.col("best_hit").alias("hit"), F.col("best_req").alias("req"))
    share = decide.found_share(hits).withColumnRenamed("share", "f_65")
    found = hits.groupBy("req_item").agg(F.countDistinct("req").alias("f_66"))
    return rows.join(hits.select("req", "hit", "item").distinct(), ["req", "hit"]).join(share, ["req_item", "item"]).join(found, "req_item").select("req_item", "issue_type", F.bround("f_1", 8).alias("f_1"), F.bround("f_65", 8).alias("f_65"), "f_66")


def txt_60_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" C:\\dir\\"), F.col("event_type"), F.lit("/"), F.repeat(F.lit("/"), F.col("event_id") % 3), F.when(F.col("event_id") % 2 == 0, F.lit("\\")).otherwise(""))
    return events(spark, sf_dir).select("event_id", T.unified_path(raw).alias("unified"), T.stripped_path(raw).alias("stripped"))


def txt_61_base_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ab_"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("pb"), F.col("event_id").cast("string"))).otherwise("12")
    return events(spark, sf_dir).select("event_id", E.base_type_of(name).alias("value"))


def txt_62_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("log_id") % 2 == 0, F.lit("  stack ")).otherwise(F.lit(" "))
    return logs(spark, sf_dir).select("log_id", E.log_text(F.col("message"), F.lit(None).cast("string"), F.lit("found"), other).alias("value"), A.comparison_text(F.lit(" m "), other).alias("both"))


def num_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("log_id") % 5
    return logs(spark, sf_dir).select(
        "log_id",
        S.text_threshold(F.lit("alpha beta gamma delta epsilon zeta eta theta iota kappa"), 0.95).alias("threshold"),
        S.whole_or_zero(F.when(k == 0, F.lit("x1")).otherwise(F.col("log_id").cast("string"))).alias("whole"),
        S.real_id(F.concat(F.col("log_id").cast("string"), F.when(k == 1, "_m").otherwise(""))).alias("real"),
        S.first_largest(F.array(F.lit(0.0), k / 4.0, F.lit(0.5))).cast("int").alias("largest"),
        T.build_url(F.lit("http://x"), F.lit("a"), k.cast("string")).alias("url"),
    )


def dat_01_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of a request that names none, as the seven numbers that messages carry."""
    return events(spark, sf_dir).select("event_id", F.array_join(S.time_parts(F.col("ts").cast("timestamp")).cast("array<string>"), ",").alias("value"))


def arr_06_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("double").alias("f_2"), F.when(F.col("event_id") % 2 == 0, 1.0).alias("f_7"))
    return E.laid_out(rows, ["f_7", "f_1", "f_2"])


def srt_11_feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = E.feature_order({3: [1, 9], 1: [2], 2: [], 5: [3], 4: []})
    return spark.createDataFrame(list(enumerate(order)), "place long, feature long")


def src_02_multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every launch's three latest error logs, in one join."""
    rows = logs(spark, sf_dir)
    asked = rows.select(F.col("launch_id").alias("req")).distinct()
    found = rows.where("log_level >= 40000").select("launch_id", "log_id", "log_time")
    return tables.multi_search(asked, found, F.col("req") == F.col("launch_id"), [F.col("log_time").desc(), F.col("log_id")], 3).select("req", "log_id")


def jon_02_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared items with the item that they came from; items without logs to keep drop out."""
    prepared = logs(spark, sf_dir).where("log_level >= 40000").groupBy("test_item_id").agg(F.count(F.lit(1)).alias("kept"))
    return prepared.join(_items(spark, sf_dir).select("test_item_id", "launch_name", "log_count"), "test_item_id")


def _written(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = f"{tables.work_folder(spark)}/faultline-{name}"
    tables.write_items(logs(spark, sf_dir).select("project", "test_item_id", "log_id"), path)
    return path


def dml_02_drop_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "drop-project")
    tables.drop_project(spark, path, 1)
    return spark.read.parquet(path).select("project", "log_id")


def dml_10_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left after one request of each route that removes."""
    items = _items(spark, sf_dir)
    steps = [("clean", ([1, 2, 3, 4],)), ("item_remove", ([101, 205],)), ("launch_remove", ([4],)), ("remove_by_launch_start_time", ("2024-01-08", "2024-01-09")), ("remove_by_log_time", ("2024-01-20 06:00:00", "2024-01-20 12:00:00")), ("delete", (3,)), ("noop_echo", ())]
    for route, values in steps:
        items = E.STORE_HANDLERS[route](items, *values).drop("removed")
    return items.select("test_item_id", "log_count")


def snk_02_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written for an item: its id and its fields that are not null."""
    rows = _items(spark, sf_dir).select("test_item_id", "launch_id", "issue_type")
    return rows.select(F.col("test_item_id").cast("string").alias("id"), F.to_json(F.struct("test_item_id", "launch_id", "issue_type")).alias("source"))


def str_01_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", intake.TRAIN_ROUTE).otherwise(F.col("event_type")).alias("route"))
    return intake.routed(messages, True).withColumn("consumer", F.lit("train")).unionByName(intake.routed(messages, False).withColumn("consumer", F.lit("other"))).groupBy("consumer").agg(F.count(F.lit(1)).alias("n"))


def str_07_train_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = logs(spark, sf_dir).groupBy("project").agg(F.sum(((F.col("log_level") >= 40000) & (F.col("project") > 0)).cast("long")).alias("indexed"))
    return intake.train_requests(counts)


def mlp_07_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis model from end to end: features of each issue type's hits, training against chance, predictions."""
    hits = decide.normalised(Q._hits(spark, sf_dir).where("issue_type IS NOT NULL"))
    features = ["f_0", "f_1", "f_3", "f_5", "f_7", "f_9", "f_26", "f_27", "f_28"]
    rows = decide.identity_features(hits, "issue_type")
    own = logs(spark, sf_dir).groupBy(F.col("test_item_id").alias("req_item")).agg(F.min("issue_type").alias("own"))
    ready = rows.join(own.where("own IS NOT NULL"), "req_item").select(F.concat_ws("|", "req_item", "issue_type").alias("id"), *features, (F.lower("issue_type") == F.lower("own")).cast("int").alias("target"))
    split = TR.stratified_split(E.laid_out(ready, features))
    model = TR.train_boosting(split.where("NOT is_test"), features, trees=10)
    return model.transform(split.where("is_test")).select("id", "target", F.col("prediction").cast("int").alias("predicted"))


_NAMES = """flt_02_nested_level flt_08_launches flt_21_history flt_23_positive ret_07_cluster_lookup ret_09_other_types ret_10_pattern_items agg_03_hits agg_11_error_groups agg_18_label_counts trn_04_entries set_03_words fea_counts
txt_60_paths txt_61_base_type txt_62_log_text num_more dat_01_now arr_06_layout srt_11_feature_order src_02_multi_search jon_02_prepared dml_02_drop_project dml_10_handlers snk_02_bodies str_01_routes str_07_train_requests
mlp_07_predict""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


_HISTORY = f"""{ORACLE_LOGS}, h AS (SELECT test_item_id, log_id, lower(issue_type) || (log_id % 3) AS t FROM logs WHERE issue_type IS NOT NULL),
present AS (SELECT test_item_id, max_by(t, log_id) AS t FROM h GROUP BY 1),
others AS (SELECT h.test_item_id, h.t, max(log_id) AS last_id FROM h JOIN present p ON p.test_item_id = h.test_item_id AND p.t <> h.t GROUP BY ALL),
past AS (SELECT test_item_id, t FROM others QUALIFY row_number() OVER (PARTITION BY test_item_id ORDER BY last_id DESC) <= 2),
kinds AS (SELECT test_item_id, t, true AS is_positive FROM present UNION ALL SELECT test_item_id, t, false FROM past),
entries AS (SELECT l.test_item_id, l.log_id, CASE WHEN regexp_full_match(k.t, '[a-z]{{2}}\\d{{0,3}}') THEN substr(k.t, 1, 2) ELSE k.t END AS issue_type, is_positive FROM logs l JOIN kinds k USING (test_item_id) JOIN present p USING (test_item_id)
  WHERE trim(l.message) <> '' AND substr(p.t, 1, 2) IN ('ab', 'pb', 'si', 'nd') AND substr(k.t, 1, 2) IN ('ab', 'pb', 'si', 'nd'))"""


def oracles() -> dict[str, str]:
    raw = "' C:\\dir\\' || event_type || '/' || repeat('/', event_id % 3) || CASE WHEN event_id % 2 = 0 THEN '\\' ELSE '' END"
    other = "CASE WHEN log_id % 2 = 0 THEN ' stack' ELSE '' END"
    return {
        "flt_23_positive": f"{Q._SIMILAR} SELECT req, item, hit FROM best WHERE probability >= 0.5",
        "agg_11_error_groups": _ERROR_GROUPS,
        "flt_02_nested_level": f"{ORACLE_LOGS} SELECT DISTINCT test_item_id FROM logs WHERE log_level >= 40000",
        "flt_08_launches": f"{ORACLE_LOGS} SELECT log_id, launch_id FROM logs WHERE launch_id IN (3, 5, 8)",
        "flt_21_history": f"{ORACLE_LOGS} SELECT DISTINCT test_item_id FROM logs WHERE issue_type IS NOT NULL",
        "ret_07_cluster_lookup": f"{_ITEMS} SELECT i.launch_id, log_id % 9 AS cluster_id, min(i.test_item_id) AS test_item_id FROM items i JOIN logs l USING (test_item_id) WHERE i.issue_type IS NOT NULL AND log_id % 9 <> 0 GROUP BY ALL",
        "ret_09_other_types": f"{Q._HITS}, t AS (SELECT DISTINCT req_item, item, lower(issue_type) AS issue_type, CASE WHEN req_item % 3 = 0 THEN 'pb001' ELSE 'nd001' END AS p FROM hits WHERE issue_type IS NOT NULL), own AS (SELECT * FROM t WHERE issue_type = p), more AS (SELECT * FROM t WHERE issue_type <> p AND req_item IN (SELECT req_item FROM own)) SELECT req_item, item, issue_type FROM (SELECT *, 1 AS turn FROM more UNION ALL SELECT *, 0 FROM own) QUALIFY row_number() OVER (PARTITION BY req_item, item ORDER BY turn DESC, issue_type) = 1",
        "ret_10_pattern_items": f"{_ITEMS} SELECT project, test_item_id, row_number() OVER (PARTITION BY project ORDER BY day DESC, test_item_id) AS place FROM items WHERE lower(issue_type[1:2]) IN ('ab', 'pb', 'si')",
        "agg_03_hits": f"{Q._HITS} SELECT req_item, count(*) AS hits, count(DISTINCT req) AS f_66 FROM hits GROUP BY 1",
        "agg_18_label_counts": f"{_HISTORY} SELECT issue_type, count(*) AS n FROM entries WHERE is_positive GROUP BY 1",
        "trn_04_entries": f"{_HISTORY} SELECT test_item_id, log_id, issue_type, is_positive FROM entries",
        "set_03_words": f"{ORACLE_LOGS} SELECT DISTINCT project, unnest({D.words('message')}) AS word FROM logs",
        "fea_counts": f"""{Q._HITS}, n AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY req_item) > 0 THEN score / max(score) OVER (PARTITION BY req_item) ELSE 1.0 END AS norm FROM hits WHERE issue_type IS NOT NULL),
s AS (SELECT *, norm / sum(norm) OVER (PARTITION BY req_item) AS share FROM n), g AS (SELECT req_item, issue_type, sum(share) AS f_0 FROM s GROUP BY ALL),
placed AS (SELECT req_item, issue_type, 1.0 / row_number() OVER (PARTITION BY req_item ORDER BY round_even(f_0, 9) DESC, issue_type) AS f_1 FROM g),
top AS (SELECT req_item, issue_type, item FROM s QUALIFY row_number() OVER (PARTITION BY req_item, issue_type ORDER BY score DESC, req, hit_pos) = 1),
q AS (SELECT req_item, count(DISTINCT req) AS asked FROM n GROUP BY 1), f AS (SELECT req_item, item, count(DISTINCT req) AS found FROM n GROUP BY ALL)
SELECT req_item, issue_type, round_even(f_1, 8) AS f_1, round_even(found / asked, 8) AS f_65, asked AS f_66 FROM placed JOIN top USING (req_item, issue_type) JOIN q USING (req_item) JOIN f USING (req_item, item)""",
        "txt_60_paths": f"SELECT event_id, replace({raw}, '\\', '/') AS unified, regexp_replace(regexp_replace(trim({raw}), '/+$', ''), '\\\\+$', '') AS stripped FROM events",
        "txt_61_base_type": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'pb' END AS value FROM events",
        "txt_62_log_text": f"{ORACLE_LOGS} SELECT log_id, CASE WHEN trim(message) <> '' THEN trim(message, ' ') || ' ' ELSE '' END || 'found' || {other} AS value, 'm' || {other} AS both FROM logs",
        "num_more": f"{ORACLE_LOGS}, k AS (SELECT log_id, log_id % 5 AS k FROM logs) SELECT log_id, CAST(0.9 AS DOUBLE) AS threshold, CASE WHEN k = 0 THEN 0 ELSE log_id END AS whole, log_id AS real, CASE WHEN k >= 2 THEN 1 ELSE 2 END AS largest, 'http://x/a/' || k AS url FROM k",
        "dat_01_now": "SELECT event_id, concat_ws(',', year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts), microsecond(ts) % 1000000) AS value FROM events",
        "arr_06_layout": "SELECT event_id AS id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS f_7, CAST(0 AS DOUBLE) AS f_1, CAST(user_id % 4 AS DOUBLE) AS f_2 FROM events",
        "srt_11_feature_order": "SELECT * FROM (VALUES (0, 2), (1, 1), (2, 3), (3, 5), (4, 4)) t(place, feature)",
        "src_02_multi_search": f"{ORACLE_LOGS} SELECT launch_id AS req, log_id FROM logs WHERE log_level >= 40000 QUALIFY row_number() OVER (PARTITION BY launch_id ORDER BY log_time DESC, log_id) <= 3",
        "jon_02_prepared": f"{ORACLE_LOGS} SELECT test_item_id, count(*) FILTER (WHERE log_level >= 40000) AS kept, min(launch_name) AS launch_name, count(*) AS log_count FROM logs GROUP BY 1 HAVING kept > 0",
        "dml_02_drop_project": f"{ORACLE_LOGS} SELECT project, log_id FROM logs WHERE project <> 1",
        "dml_10_handlers": f"{_ITEMS}, kept AS (SELECT l.test_item_id, count(*) AS log_count FROM logs l WHERE log_id NOT IN (1, 2, 3, 4) AND NOT (log_time BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00') GROUP BY 1) SELECT test_item_id, log_count FROM kept JOIN items USING (test_item_id) WHERE test_item_id NOT IN (101, 205) AND launch_id <> 4 AND day NOT BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-09' AND project <> 3",
        "snk_02_bodies": f"{_ITEMS} SELECT CAST(test_item_id AS STRING) AS id, '{{\"test_item_id\":' || test_item_id || ',\"launch_id\":' || launch_id || CASE WHEN issue_type IS NULL THEN '' ELSE ',\"issue_type\":\"' || issue_type || '\"' END || '}}' AS source FROM items",
        "str_01_routes": "SELECT CASE WHEN event_type = 'error' THEN 'train' ELSE 'other' END AS consumer, count(*) AS n FROM events GROUP BY 1",
        "str_07_train_requests": f"{ORACLE_LOGS}, c AS (SELECT project, count(*) FILTER (WHERE log_level >= 40000 AND project > 0) AS n FROM logs GROUP BY 1) SELECT 'train_models' AS route, project, '{{\"model_type\":\"' || k || '\",\"project\":' || project || ',\"gathered_metric_total\":' || n || '}}' AS body FROM c, (SELECT unnest(['suggestion', 'auto_analysis', 'defect_type']) AS k) WHERE n > 0",
        "sim_08_request_messages": last_unique_sql("message", "log_level >= 40000 AND trim(message) <> ''") + "SELECT test_item_id AS req, log_id FROM chosen WHERE back <= 3",
    }
