"""Global order over a table without a single-partition window.

Keys are cut into range buckets at approximate quantiles, so that each bucket
holds a bounded share of the rows.  Ranks and prefix sums are then taken inside
the buckets, and the few per-bucket totals (one row per bucket) give every bucket
its base.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import stored

#: Quantiles that are read; where more buckets are wanted, the keys between two of them are divided evenly.
QUANTILES = 2048
#: Bucket numbers between two quantiles.
ROOM = 1 << 32


def range_buckets(df: DataFrame, key: str, tie: Column, rows_per_bucket: int = 2500, bytes_per_bucket: int = 12 << 20, size: Column | None = None) -> Column:
    """A column that maps ``key`` (a long, null first) to the number of its range bucket, a long that ascends with (key, tie).

    One pass reads the row count, the bytes in ``size`` and the quantiles; what
    reaches the driver is ``QUANTILES`` numbers, however many buckets there are.  A key
    that fills several quantiles is dealt to as many buckets by ``tie``, a hash; only
    rows equal in both stay together.
    """
    grid = [i / QUANTILES for i in range(1, QUANTILES)]
    total = F.sum(size) if size is not None else F.lit(0)
    n, nbytes, quantiles = df.agg(F.count(F.lit(1)), total, F.percentile_approx(key, grid, 4 * QUANTILES)).first()
    wanted = max(1, math.ceil(max(n / rows_per_bucket, (nbytes or 0) / bytes_per_bucket)))
    steps = min(wanted, QUANTILES)
    taken = [quantiles[i * QUANTILES // steps - 1] for i in range(1, steps)] if quantiles else []
    if not taken:
        return F.lit(0).cast("long")
    fine = math.ceil(wanted / QUANTILES)
    cuts = sorted(set(taken))
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    side = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    position = F.coalesce(F.col(key), F.lit(-(2**63)))
    group = F.size(F.filter(long([g[0] for g in groups]), lambda c: c <= position))
    own = F.get(F.array(*[long(g) for g in groups]), group - 1)
    inside = F.size(F.filter(own, lambda c: c <= position))
    passed = F.when(group == 0, F.lit(0)).otherwise((group - 1) * side + inside)
    share = lambda x, parts: F.least(F.floor(x * parts), parts - F.lit(1)).cast("long")
    offset = F.lit(0).cast("long")
    often = {c: taken.count(c) * fine for c in cuts if taken.count(c) > 1 or fine > 1}
    if often:
        first = F.get(own, inside - 1)
        after = F.get(long([*cuts[1:], 2**63 - 1]), passed - 1)
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in often.items() for x in pair]), first), F.lit(1))
        by_tie = share((tie.cast("double") + 2.0**63) / 2.0**64, parts)
        between = share((position.cast("double") - first) / (after.cast("double") - first), F.lit(fine))
        offset = F.when(passed == 0, F.lit(0)).when(position == first, by_tie).otherwise(F.lit(ROOM // 2) + between).cast("long")
    return passed.cast("long") * ROOM + offset


def with_prefix_sums(df: DataFrame, bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each ``name: value`` of ``sums``, the exclusive global prefix sum of the value in (bucket, order)."""
    inner = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = {f"_v_{name}": value.cast("long") for name, value in sums.items()}
    df = df.withColumns(values)
    totals = df.groupBy(bucket).agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select(F.col(bucket).alias("_bucket"), *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_b{v}") for v in values]), "bases")  # one row per bucket
    local = df.withColumns({f"_l{v}": F.sum(v).over(inner) - F.col(v) for v in values})
    joined = local.join(bases, F.col(bucket) == F.col("_bucket"))
    return joined.withColumns({name: F.col(f"_l_v_{name}") + F.col(f"_b_v_{name}") for name in sums}).drop(
        "_bucket", *[f"{p}{v}" for v in values for p in ("", "_l", "_b")]
    )
