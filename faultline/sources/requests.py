"""Requests and responses as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Request shapes.
LOG = "logId BIGINT, logLevel INT, logTime ARRAY<INT>, message STRING, clusterId BIGINT, clusterMessage STRING"
ITEM = f"testItemId BIGINT, isAutoAnalyzed BOOLEAN, issueType STRING, testItemName STRING, testCaseHash BIGINT, uniqueId STRING, startTime ARRAY<INT>, logs ARRAY<STRUCT<{LOG}>>"
LAUNCH = f"launchId BIGINT, project BIGINT, launchName STRING, launchNumber INT, previousLaunchId BIGINT, launchStartTime ARRAY<INT>, testItems ARRAY<STRUCT<{ITEM}>>"
SEARCH = "launchId BIGINT, launchName STRING, itemId BIGINT, projectId BIGINT, filteredLaunchIds ARRAY<BIGINT>, logMessages ARRAY<STRING>, logLines INT"
DELETE_LOGS = "ids ARRAY<BIGINT>, project BIGINT"
DELETE_ITEMS = "project BIGINT, itemsToDelete ARRAY<BIGINT>"
DELETE_LAUNCHES = "project BIGINT, launch_ids ARRAY<BIGINT>"
DELETE_RANGE = "project BIGINT, interval_start_date STRING, interval_end_date STRING"
DEFECT_UPDATE = "project BIGINT, itemsToUpdate STRING"
TRAIN = "model_type STRING, project BIGINT, additional_projects ARRAY<BIGINT>, gathered_metric_total INT"
ROUTES = {
    "index": LAUNCH, "analyze": LAUNCH, "cluster": LAUNCH, "search": SEARCH, "suggest": ITEM, "clean": DELETE_LOGS, "item_remove": DELETE_ITEMS, "launch_remove": DELETE_LAUNCHES,
    "remove_by_launch_start_time": DELETE_RANGE, "remove_by_log_time": DELETE_RANGE, "defect_update": DEFECT_UPDATE, "train_models": TRAIN,
}


def parse(raw: DataFrame, shape: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rows that are no JSON of this shape, as they came)."""
    parsed = raw.withColumn("_parsed", F.from_json(F.col(column), f"{shape}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("_parsed IS NOT NULL AND _parsed._bad IS NULL").select("_parsed.*").drop("_bad")
    return good, parsed.where("_parsed IS NULL OR _parsed._bad IS NOT NULL").select(column)


def log_rows(launches: DataFrame) -> DataFrame:
    """One row per log of parsed launches, with its item and launch."""
    items = launches.select("project", F.col("launchId").alias("launch_id"), F.col("launchName").alias("launch_name"), F.explode("testItems").alias("i"))
    rows = items.select("project", "launch_id", "launch_name", F.col("i.testItemId").alias("test_item_id"), F.col("i.issueType").alias("issue_type"), F.posexplode("i.logs").alias("log_order", "l"))
    return rows.select("project", "launch_id", "launch_name", "test_item_id", "issue_type", "log_order", F.col("l.logId").alias("log_id"), F.col("l.logLevel").alias("log_level"), F.col("l.message").alias("message"))


def to_responses(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON texts; null fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))
