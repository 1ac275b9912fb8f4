"""Changes of the test-item table; each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace stored rows with their key."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by(stored: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(ids.select(*key).distinct(), key, "left_anti")


def delete_between(stored: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """Rows outside the closed range stay, and rows without a value."""
    return stored.where(F.col(column).isNull() | ~F.col(column).between(first, last))


def delete_logs(stored: DataFrame, unwanted, logs: str = "logs") -> DataFrame:
    """Nested logs for which ``unwanted(log)`` holds go, and items that had logs and have none left; adds ``removed``."""
    kept = stored.withColumn("_kept", F.filter(logs, lambda x: ~F.coalesce(unwanted(x), F.lit(False))))
    kept = kept.withColumn("removed", F.size(logs) - F.size("_kept")).where((F.size("_kept") > 0) | (F.col("removed") == 0))
    return kept.withColumn(logs, F.col("_kept")).withColumn("log_count", F.size("_kept")).drop("_kept")


def defect_update(stored: DataFrame, updates: DataFrame, key: str = "test_item_id") -> tuple[DataFrame, DataFrame]:
    """(the table, ids not found): sets the type, clears the automatic flag and adds to the history.

    ``updates`` has (key, issue_type, issue_comment, timestamp); blank types are ignored.
    """
    given = updates.where(F.coalesce(F.trim("issue_type"), F.lit("")) != "").dropDuplicates([key])
    change = given.select(key, F.struct(F.lit(False).alias("is_auto_analyzed"), "issue_type", "timestamp", "issue_comment").alias("_new"))
    joined = stored.join(change, key, "left")
    hit = F.col("_new").isNotNull()
    past = F.coalesce("issue_history", F.array().cast(stored.schema["issue_history"].dataType))
    done = joined.withColumns(
        {
            "issue_history": F.when(hit, F.array_append(past, F.col("_new").cast(stored.schema["issue_history"].dataType.elementType))).otherwise(F.col("issue_history")),
            "issue_type": F.when(hit, F.col("_new.issue_type")).otherwise(F.col("issue_type")),
            "is_auto_analyzed": F.when(hit, F.lit(False)).otherwise(F.col("is_auto_analyzed")),
        }
    ).drop("_new")
    return done.select(*stored.columns), given.select(key).join(stored.select(key), key, "left_anti")


def cluster_update(stored: DataFrame, updates: DataFrame, key: str = "test_item_id") -> DataFrame:
    """Sets the cluster fields of nested logs; ``updates`` has (key, log_id, cluster_id, cluster_message)."""
    by_item = updates.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("log_id", F.struct("cluster_id", "cluster_message")))).alias("_u"))

    def change(x: Column) -> Column:
        u = F.try_element_at("_u", x["log_id"])
        return x.withField("cluster_id", F.coalesce(u["cluster_id"], x["cluster_id"])).withField("cluster_message", F.coalesce(u["cluster_message"], x["cluster_message"]))

    joined = stored.join(by_item, key, "left")
    return joined.withColumn("logs", F.when(F.col("_u").isNull(), F.col("logs")).otherwise(F.transform("logs", change))).drop("_u")
