"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.ordering import range_buckets, with_prefix_sums

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into ``n_shards`` contiguous shards whose byte sizes are nearly equal.

    Rows are ordered by id and a hash of (size, checksum); a row of ``size`` bytes that starts at
    byte ``start`` of ``total`` goes to the shard that holds its midpoint, so a
    shard's bytes differ from the target by less than its two border rows.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the
    row's global ``start_byte``.  Null texts are empty, null ids come first, repeated
    rows each take a place of their own, a text beyond the target fills a shard
    alone, and an empty table gives no rows.  Other columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    bucket = range_buckets(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", F.xxhash64("size", "text_crc32"), rows_per_bucket=20_000)
    placed = with_prefix_sums(
        thin.withColumn("_k", bucket),
        "_k",
        [F.col("doc_id").asc_nulls_first(), F.xxhash64("size", "text_crc32"), F.col("size"), F.col("text_crc32")],
        {"start_byte": F.col("size"), "_rank": F.lit(1)},
    ).drop("_k")
    total = thin.agg(F.sum("size").alias("_total"))
    middle = F.expr(f"((2 * start_byte + size) * {int(n_shards)}) div (2 * _total)")
    dealt = placed.join(F.broadcast(total)).withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))  # one row
    firsts = dealt.groupBy("shard").agg(F.min("_rank").alias("_first"))  # at most n_shards rows
    return dealt.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_byte",
    )
