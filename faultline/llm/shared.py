"""Tables kept between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Rows of an Arrow batch while a table is stored; texts of a batch are held by Spark and by the worker at once.
BATCH_ROWS = 2000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder on one machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="faultline-"))
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile give their workers no more than ``BATCH_ROWS`` rows at once."""
    given = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, min(int(given), BATCH_ROWS) if int(given) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, given)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: lineage ends there, and any executor can go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/faultline/{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)
