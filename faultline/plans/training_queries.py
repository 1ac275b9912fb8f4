"""Queries of training data, models, triggers, sources and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import training as T
from faultline.plans import duck as D
from faultline.plans.logs import ORACLE_LOGS, events, logs
from faultline.sources import requests, tables
from faultline.streaming import intake


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).where("issue_type IS NOT NULL").select(F.col("log_id").alias("id"), "issue_type", (F.col("log_id") % 5 != 0).alias("is_positive"), F.col("message").alias("text"))


def trn_02_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.balance(_entries(spark, sf_dir), ["ab", "pb", "si"]).groupBy("label", "target").agg(F.count(F.lit(1)).alias("n"))


def trn_03_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.binary_target(_entries(spark, sf_dir), "pb").groupBy("issue_type", "target").agg(F.count(F.lit(1)).alias("n"))


def trn_05_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).where("issue_type IS NOT NULL").select(F.col("test_case_hash").alias("req_item"), F.col("log_id").alias("pos"), F.lower("issue_type").alias("issue_type"), F.lit("pb001").alias("positive_type"), F.array(F.lit("si001"), F.lit("nd001")).alias("past_types"))
    return T.select_candidates(rows).groupBy("req_item", "target").agg(F.count(F.lit(1)).alias("n"))


def trn_06_history_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = logs(spark, sf_dir).select("test_item_id").distinct().withColumn("past_types", F.when(F.col("test_item_id") % 2 == 0, F.array(F.lit("ab001"), F.lit("si001"))).otherwise(F.array(F.lit("nd001"))))
    return T.history_hits(items)


def trn_08_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.stratified_split(T.binary_target(_entries(spark, sf_dir), "ab"))
    return rows.groupBy("target").agg(F.bround(F.avg(F.col("is_test").cast("double")), 1).alias("share"))


def mlp_01_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("value") > 40).cast("int").alias("target"), F.col("value").alias("f_0"), (F.col("user_id") % 7).cast("double").alias("f_1"))
    split = T.stratified_split(rows)
    model = T.train_boosting(split.where("NOT is_test"), ["f_0", "f_1"], trees=10)
    return model.transform(split.where("is_test").fillna(0.0)).select("id", "target", F.col("prediction").cast("int").alias("predicted"))


def mlp_03_defect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_tokens(T.binary_target(_entries(spark, sf_dir), "pb"))
    kept = T.spread_split(tables.kept(rows.select("id", "target", "tokens"), "defect-type"))
    kept = tables.kept(kept, "defect-type-split")
    model = T.train_defect_type(kept.where("NOT is_test"))
    return model.transform(kept.where("is_test")).select("id", "target", F.col("prediction").cast("int").alias("predicted"))


def mlp_06_model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select(F.col("user_id").alias("project")).distinct()
    return users.select("project", T.choose_custom(F.col("project"), "suggestion", 0.3).alias("custom"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("project", F.col("launch_id").alias("seq")).agg(F.sum((F.col("log_level") >= 40000).cast("long")).alias("gathered")).withColumn("model", F.lit("defect_type"))


def trn_14_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trigger_state(_counts(spark, sf_dir))


def agg_17_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = (F.coalesce("issue_type", F.lit("")) != "") & ~F.lower("issue_type").startswith("ti")
    return logs(spark, sf_dir).groupBy("project").agg(F.sum(F.coalesce(known, F.lit(False)).cast("long")).alias("defects"))


def agg_22_launch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("launch_id").agg(F.countDistinct("test_item_id").alias("items"), F.count(F.lit(1)).alias("logs"), F.sum(F.col("issue_type").isNull().cast("long")).alias("not_found"))


def src_01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{tables.work_folder(spark)}/faultline-items"
    tables.write_items(logs(spark, sf_dir).select("project", "log_id", "launch_id", "message"), path)
    return tables.scan(spark, path, 2, F.col("launch_id") > 10).select("log_id", "launch_id")


def src_03_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = logs(spark, sf_dir).where("amount > 40").select("log_id")
    return tables.by_ids(logs(spark, sf_dir), ids, "log_id").select("log_id", "launch_id")


def src_04_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").alias("launchId"), F.col("user_id").alias("project"), F.array(F.struct(F.col("event_id").alias("testItemId"), F.lit("ab001").alias("issueType"))).alias("testItems"))))
    good, bad = requests.parse(events(spark, sf_dir).select(raw.alias("value")), requests.LAUNCH, "value")
    rows = good.select("launchId", "project", F.size("testItems").alias("items"), F.lit(False).alias("broken"))
    return rows.unionByName(bad.agg(F.lit(None).cast("long").alias("launchId"), F.count(F.lit(1)).alias("project"), F.lit(None).cast("int").alias("items"), F.lit(True).alias("broken")))


def src_07_launch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    launch = F.struct(F.col("launch_id").cast("long").alias("launchId"), F.col("project").cast("long").alias("project"))
    nested = logs(spark, sf_dir).groupBy("project", "launch_id", "test_item_id").agg(F.collect_list(F.struct(F.col("log_id").alias("logId"), F.col("log_level").alias("logLevel"), "message")).alias("logs"))
    built = nested.groupBy("project", "launch_id").agg(F.collect_list(F.struct(F.col("test_item_id").alias("testItemId"), "logs")).alias("testItems")).select(launch["launchId"].alias("launchId"), launch["project"].alias("project"), "testItems")
    text = built.select(F.to_json(F.struct("*")).alias("value"))
    return requests.log_rows(requests.parse(text, requests.LAUNCH, "value")[0]).select("project", "launch_id", "test_item_id", "log_id", "log_level")


def snk_06_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.to_responses(logs(spark, sf_dir).select("test_item_id", "issue_type").distinct().select("test_item_id", "issue_type"), ["test_item_id", "issue_type"])


def snk_07_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tables.ObjectStore(spark, f"{tables.work_folder(spark)}/faultline-objects")
    store.put(7, "namespaces/words.json", {"acme": 3})
    store.put(7, "other.json", {"x": 1})
    store.remove(7, "other.json")
    found = [(n, str(store.get(7, n))) for n in store.names(7)]
    return spark.createDataFrame(found, "name string, value string")


def str_02_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = events(spark, sf_dir).select(F.col("event_id").alias("number"), F.concat((F.col("user_id") * 1000).cast("string"), F.when(F.col("event_id") % 2 == 0, "L").otherwise("")).alias("timestamp"))
    ordered = messages.withColumn("priority", intake.priority(F.col("timestamp"), F.lit(0)))
    return intake.placed(ordered, tables.work_folder(spark)).select("number", "priority", "place")


def str_06_stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigger totals of a stream over the events files, after all of it has been read."""
    return intake.gathered_totals(spark, f"{sf_dir}/events*.parquet", events(spark, sf_dir).schema, tables.work_folder(spark))


_NAMES = """trn_02_balance trn_03_targets trn_05_candidates trn_06_history_hits trn_08_split mlp_01_boosting mlp_03_defect_type mlp_06_model_choice trn_14_triggers agg_17_defects agg_22_launch_stats src_01_scan src_03_by_ids
src_04_requests src_07_launch_rows snk_06_responses snk_07_objects str_02_priority str_06_stream_triggers""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


_ENTRIES = f"{ORACLE_LOGS}, entries AS (SELECT log_id AS id, issue_type, lower(issue_type[1:2]) AS base, log_id % 5 <> 0 AS positive FROM logs WHERE issue_type IS NOT NULL)"


def oracles() -> dict[str, str]:
    return {
        "mlp_06_model_choice": f"SELECT project, {D.hex_modulus('h', 32, 100)} <= 30 AS custom FROM (SELECT DISTINCT user_id AS project, md5(user_id || '|suggestion') AS h FROM events)",
        "trn_02_balance": f"{_ENTRIES}, labels AS (SELECT unnest(['ab', 'pb', 'si']) AS label), c AS (SELECT label, count(*) FILTER (WHERE base = label AND positive) AS p, count(*) FILTER (WHERE NOT (base = label AND positive) AND (base = label OR positive)) AS n FROM entries, labels GROUP BY 1) SELECT label, 1 AS target, p AS n FROM c UNION ALL SELECT label, 0, least(n, 4 * p) FROM c",
        "trn_03_targets": f"{_ENTRIES} SELECT issue_type, CAST(base = 'pb' AND positive AS INTEGER) AS target, count(*) AS n FROM entries GROUP BY ALL",
        "trn_05_candidates": f"{ORACLE_LOGS}, c AS (SELECT test_case_hash AS req_item, count(*) FILTER (WHERE lower(issue_type) = 'pb001') AS p, count(DISTINCT lower(issue_type)) FILTER (WHERE lower(issue_type) IN ('si001', 'nd001')) AS h, count(*) FILTER (WHERE lower(issue_type) NOT IN ('pb001', 'si001', 'nd001')) AS o FROM logs WHERE issue_type IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT req_item, 1 AS target, p AS n FROM c UNION ALL SELECT req_item, 0, h + least(o, 4 * greatest(p, 1)) FROM c) WHERE n > 0",
        "trn_06_history_hits": f"{ORACLE_LOGS}, i AS (SELECT DISTINCT test_item_id AS t FROM logs) SELECT t AS req_item, -(t * 10 + 1) AS item, CASE WHEN t % 2 = 0 THEN 'ab001' ELSE 'nd001' END AS issue_type, CAST(0.0001 AS DOUBLE) AS score FROM i UNION ALL SELECT t, -(t * 10 + 2), 'si001', CAST(0.0001 AS DOUBLE) FROM i WHERE t % 2 = 0",
        "trn_08_split": "SELECT unnest([0, 1]) AS target, CAST(0.1 AS DOUBLE) AS share",
        "agg_17_defects": f"{ORACLE_LOGS} SELECT project, count(*) FILTER (WHERE issue_type IS NOT NULL AND lower(issue_type) NOT LIKE 'ti%') AS defects FROM logs GROUP BY 1",
        "agg_22_launch_stats": f"{ORACLE_LOGS} SELECT launch_id, count(DISTINCT test_item_id) AS items, count(*) AS logs, count(*) FILTER (WHERE issue_type IS NULL) AS not_found FROM logs GROUP BY 1",
        "trn_14_triggers": f"""{ORACLE_LOGS}, c AS (SELECT project, launch_id AS seq, sum(CAST(log_level >= 40000 AS BIGINT)) AS g FROM logs GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM c),
w AS (WITH RECURSIVE r AS (SELECT project, 0 AS k, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS fired FROM (SELECT DISTINCT project FROM c)
  UNION ALL SELECT r.project, o.k, CAST(total + g AS BIGINT), CAST(CASE WHEN total + g >= 100 AND since + g >= 100 THEN 0 ELSE since + g END AS BIGINT), CAST(fired + CASE WHEN total + g >= 100 AND since + g >= 100 THEN 1 ELSE 0 END AS BIGINT) FROM r JOIN o ON o.project = r.project AND o.k = r.k + 1) SELECT * FROM r)
SELECT project, 'defect_type' AS model, total, fired, since FROM w QUALIFY row_number() OVER (PARTITION BY project ORDER BY k DESC) = 1""",
        "src_01_scan": f"{ORACLE_LOGS} SELECT log_id, launch_id FROM logs WHERE project = 2 AND launch_id > 10",
        "src_03_by_ids": f"{ORACLE_LOGS} SELECT log_id, launch_id FROM logs WHERE amount > 40",
        "src_04_requests": "SELECT event_id AS launchId, user_id AS project, 1 AS items, false AS broken FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, count(*), NULL, true FROM events WHERE event_id % 10 = 3",
        "src_07_launch_rows": f"{ORACLE_LOGS} SELECT project, launch_id, test_item_id, log_id, log_level FROM logs",
        "snk_06_responses": f"{ORACLE_LOGS} SELECT DISTINCT '{{\"test_item_id\":' || test_item_id || CASE WHEN issue_type IS NULL THEN '' ELSE ',\"issue_type\":\"' || issue_type || '\"' END || '}}' AS value FROM logs",
        "snk_07_objects": "SELECT 'namespaces/words.json' AS name, '{''acme'': 3}' AS value",
        "str_02_priority": "SELECT event_id AS number, user_id * 1000 AS priority, row_number() OVER (ORDER BY user_id, event_id) AS place FROM events",
        "str_06_stream_triggers": "SELECT user_id % 4 AS project, count(*) FILTER (WHERE event_type = 'error') AS gathered FROM events GROUP BY 1",
    }
