"""Finding similar stored logs: term weights, clauses, boosts, decay and the choice of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.functions.text import split_words

K1, B = 1.2, 0.75
MOST_TERMS = 50


def postings(logs: DataFrame, field: str, scope: str = "project", key: str | None = None) -> DataFrame:
    """(scope, log_id, term, tf, length) of a text field, with the column ``key`` if one is named."""
    own = [scope, "log_id", *([key] if key else [])]
    words = logs.select(*own, split_words(F.col(field), unique=False).alias("w")).withColumn("length", F.size("w"))
    return words.select(*own, "length", F.explode("w").alias("term")).groupBy(*own, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def more_like_this(requests: DataFrame, stored: DataFrame, boost: float = 1.0, should_match: float = 0.0, scope: str = "project", most_terms: int = MOST_TERMS, key: str | None = None) -> DataFrame:
    """(scope, req, hit, score, matched): BM25 over the request's best terms, for hits that match enough of them.

    ``requests`` and ``stored`` are ``postings``; the request's terms are its top ones by
    tf x idf (ties: by term).  Up to five terms must all match, of more a share.  With
    ``key``, request and hit must agree in that column of the postings.  Spark estimates
    postings by the size of the files, far too low, so the joins are told to sort: it must
    not collect them in the driver to broadcast them.
    """
    also = [key] if key else []
    size = stored.select(scope, "log_id", "length").distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avgdl"))
    df = stored.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df")).join(size, scope)
    idf = df.withColumn("idf", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = requests.select(scope, *also, F.col("log_id").alias("req"), "term", F.col("tf").alias("req_tf")).join(idf.hint("merge"), [scope, "term"])
    best = Window.partitionBy(scope, "req").orderBy(F.bround(F.col("req_tf") * F.col("idf"), 9).desc(), "term")
    chosen = asked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most_terms).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy(scope, "req")))
    tf, length = F.col("tf"), F.col("length")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avgdl")))
    met = chosen.join(stored.select(scope, *also, F.col("log_id").alias("hit"), "term", "tf", "length").hint("merge"), [scope, *also, "term"]).where("req <> hit")
    scored = met.groupBy(scope, "req", "hit").agg((F.lit(boost) * F.sum(weight)).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("terms").alias("terms"))
    wanted = F.when(F.col("terms") <= 5, F.col("terms")).otherwise(F.floor(F.col("terms") * should_match)) if should_match else F.lit(0)
    return scored.where(F.col("matched") >= wanted).select(scope, "req", "hit", F.bround("score", 6).alias("score"), "matched")


def nested_score(hits: DataFrame, mode: str = "avg") -> DataFrame:
    """(req, item, score): the scores of an item's logs, averaged, summed, or their largest or smallest."""
    return hits.groupBy("req", "item").agg(getattr(F, mode)("score").alias("score"))


def inner_hits(hits: DataFrame, most: int = 5) -> DataFrame:
    """The best logs of each item of a request."""
    best = Window.partitionBy("req", "item").orderBy(F.col("score").desc(), "hit")
    return hits.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= most)


def top_hits(scored: DataFrame, most: int = 10) -> DataFrame:
    """The best items of each request: by score, then the latest start, then the smaller id; ``hit_pos`` counts from 0."""
    best = Window.partitionBy("req").orderBy(F.col("score").desc(), F.col("start_time").desc(), "item")
    return scored.withColumn("hit_pos", F.row_number().over(best) - 1).where(F.col("hit_pos") < most)


def first_of_each(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def in_launch_scope(mode: str, req: str = "r", hit: str = "h") -> Column:
    """Which launches an analysis looks at: of the same name, this one, the previous one, or all."""
    same_name = F.col(f"{req}.launch_name") == F.col(f"{hit}.launch_name")
    same_id = F.col(f"{req}.launch_id") == F.col(f"{hit}.launch_id")
    scopes = {
        "LAUNCH_NAME": same_name & ~same_id,
        "CURRENT_AND_THE_SAME_NAME": same_name,
        "CURRENT_LAUNCH": same_id,
        "PREVIOUS_LAUNCH": F.col(f"{req}.previous_launch_id") == F.col(f"{hit}.launch_id"),
        "ALL": ~same_id,
    }
    return scopes.get(mode, F.lit(True))


def launch_boost(boost: float, mode: str, req: str = "r", hit: str = "h") -> Column:
    """What a hit of a preferred launch gains in a suggestion, where no launch is left out."""
    gain = lambda when, by: F.when(when, F.lit(by)).otherwise(F.lit(0.0))
    same_name = F.col(f"{req}.launch_name") == F.col(f"{hit}.launch_name")
    same_id = F.col(f"{req}.launch_id") == F.col(f"{hit}.launch_id")
    if mode == "PREVIOUS_LAUNCH":
        return gain(F.col(f"{req}.previous_launch_id") == F.col(f"{hit}.launch_id"), boost)
    if mode in ("LAUNCH_NAME", "CURRENT_AND_THE_SAME_NAME"):
        return gain(same_name, boost) + gain(same_id, 1 / boost)
    return gain(same_id, boost) + gain(same_name, boost)


def analysed_boost(is_auto: Column, auto: float, manual: float) -> Column:
    """The gain of items analysed in the way that weighs more."""
    return F.when(is_auto == F.lit(auto > manual), F.lit(abs(manual - auto))).otherwise(F.lit(0.0))


def decayed(score: Column, now: Column, start: Column, rate: float, floor: float) -> Column:
    return score * S.relevance_decay(now, start, rate, floor)


def has_defect(issue_type: Column, no_defect_too: bool = False) -> Column:
    """Neither to be investigated nor (unless asked for) no defect."""
    base = F.lower(F.substring(issue_type, 1, 2))
    return issue_type.isNotNull() & ~base.isin(["ti"] if no_defect_too else ["ti", "nd"])
