"""Bitmaps of fixed size over 64-bit hashes: cheap filters that never lose a member.

A bitmap only saves work.  Members always pass; a non-member passes by chance,
and whatever uses a bitmap checks exactly afterwards.  Its size is a constant, so
broadcasting it is safe at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import small_batches

BLOCKS = 256


def bitmap(hashes: DataFrame, column: str, bits: int = 28) -> Broadcast:
    """A broadcast bitmap of ``2**bits`` bits (32 MB for 28) in which the top bits of every hash are set.

    Each block of the bitmap is filled by one task from distinct positions, and only
    finished blocks reach the driver.
    """
    low = bits - 8
    position = F.shiftrightunsigned(F.col(column), 64 - bits)
    positions = hashes.select(F.shiftright(position, low).cast("int").alias("block"), position.bitwiseAND((1 << low) - 1).cast("int").alias("at")).distinct()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << low, np.uint8)
        flags[group["at"].to_numpy()] = 1
        return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    blocks = positions.groupBy("block").applyInPandas(fill, "block int, flags binary").collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = len(whole) // BLOCKS
    for row in blocks:
        whole[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["flags"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole.tobytes())


def in_bitmap(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be members."""
    bits = int(len(flags) * 8).bit_length() - 1
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def spread_hashes(hashes: Iterator[np.ndarray], buckets: int, flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, hashes): the distinct hashes of a stream by their top bits, the next 32 bits of each, twice if it came twice.

    ``buckets`` is a power of two.  Streams are merged in steps of about ``flush`` hashes.
    """
    top = np.uint64(64 - (buckets.bit_length() - 1))

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.sort(np.concatenate(held) >> (top - np.uint64(32)))
        keep = np.ones(len(found), bool)
        keep[2:] = found[2:] != found[:-2]
        found = found[keep]
        bucket = (found >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        low = found.astype("<u4")
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "hashes"])

    held, n = [], 0
    for x in hashes:
        held.append(x)
        n += len(x)
        if n >= flush:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def repeated_bitmap(spread, n_hashes: int, most_bits: int = 28) -> Broadcast:
    """A broadcast bitmap of the hashes that come at least twice; ``spread(buckets)`` has the rows of ``spread_hashes``.

    It has four bits for each hash, but no more than ``2**most_bits``.  There are as many buckets as hold about two million hashes each, so that a task's
    share does not grow with the table; each gives its own part of the bitmap.
    """
    spare = min(20, max(8, (n_hashes // 2_000_000).bit_length()))
    bits = min(most_bits, max(20, (4 * n_hashes).bit_length()))
    spare = min(spare, bits - 3)
    rows = spread(1 << spare)

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(np.concatenate([np.frombuffer(h, "<u4") for h in group["hashes"]]))
        flags = np.zeros(1 << (bits - spare), np.uint8)
        flags[found[1:][found[1:] == found[:-1]] >> np.uint32(32 - bits + spare)] = 1
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    with small_batches(rows.sparkSession):
        parts = rows.groupBy("bucket").applyInPandas(repeated, "bucket int, flags binary").collect()  # 2**bits bits
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = len(whole) >> spare
    for row in parts:
        whole[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["flags"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(whole.tobytes())


def counted_batches(hashes: Iterator[np.ndarray], flush: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct hashes, counts) of a stream, merged in steps of about ``flush`` hashes before they are shuffled."""
    held, n = [], 0
    for x in hashes:
        held.append(x)
        n += len(x)
        if n >= flush:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)
