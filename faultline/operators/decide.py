"""From candidate pairs to features, ranked items, suggestions and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.functions.patterns import CERTAIN_TYPES
from faultline.operators.similarity import overlap, similarity, value_overlap, values, with_terms

#: Feature id -> text field whose similarity to the best hit it is.
SIMILAR_FIELDS = {
    11: "message", 18: "detected_message", 19: "detected_message_with_numbers", 23: "stacktrace", 29: "message_params", 34: "found_exceptions", 36: "detected_message_extended",
    37: "detected_message_without_params_extended", 38: "stacktrace_extended", 40: "message_without_params_extended", 41: "message_extended",
    53: "detected_message_without_params_and_brackets", 59: "found_tests_and_methods", 61: "test_item_name",
}


def both_ways(rows: DataFrame, common: list[str], left: str = "a_", right: str = "b_") -> DataFrame:
    """Each pair twice, with its sides exchanged: what was ``a_x`` and ``b_x`` is ``r_x`` and ``h_x``, then ``h_x`` and ``r_x``."""
    names = [c.removeprefix(left) for c in rows.columns if c.startswith(left)]
    way = lambda r, h: F.struct(*[F.col(f"{r}{n}").alias(f"r_{n}") for n in names], *[F.col(f"{h}{n}").alias(f"h_{n}") for n in names], *common)
    return rows.select(F.inline(F.array(way(left, right), way(right, left))))


def one_per_case_and_score(hits: DataFrame) -> DataFrame:
    """Of a request's hits on one test case, the latest for each whole score."""
    best = Window.partitionBy("req", "test_case_hash", F.floor("score")).orderBy(F.col("start_time").desc(), "hit")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def keep_similar(hits: DataFrame, fields: list[str], least: Column) -> DataFrame:
    """Keeps hits whose similarity in any of the columns reaches the bound."""
    return hits.where(F.greatest(*fields, F.lit(0.0)) >= least)


def keep_by_first_field(hits: DataFrame, fields: list[str], least: Column, group: str = "req_item") -> DataFrame:
    """Filters by the first field that removes any hit of a request; later fields are not looked at."""
    whole = Window.partitionBy(group)
    step = hits
    for k, f in enumerate(fields):
        step = step.withColumn(f"_low{k}", F.max((F.coalesce(f, F.lit(0.0)) < least).cast("int")).over(whole))
    decided = F.lit(True)
    for k in reversed(range(len(fields))):
        decided = F.when(F.col(f"_low{k}") == 1, F.coalesce(fields[k], F.lit(0.0)) >= least).otherwise(decided)
    return step.where(decided).drop(*[f"_low{k}" for k in range(len(fields))])


def found_share(hits: DataFrame) -> DataFrame:
    """(req_item, item, share): of the request's logs with results, those that found the item."""
    asked = hits.groupBy("req_item").agg(F.countDistinct("req").alias("asked"))
    return hits.groupBy("req_item", "item").agg(F.countDistinct("req").alias("found")).join(asked, "req_item").select("req_item", "item", (F.col("found") / F.col("asked")).alias("share"))


def normalised(hits: DataFrame) -> DataFrame:
    """Adds ``norm``: the score against the best of the request item, 1 if there is none above zero."""
    best = F.max("score").over(Window.partitionBy("req_item"))
    return hits.withColumn("norm", F.when(best > 0, F.col("score") / best).otherwise(F.lit(1.0)))


def identity_features(hits: DataFrame, identity: str = "issue_type") -> DataFrame:
    """One row per (req_item, identity): its best hit and the features of scores and counts.

    ``hits`` has (req_item, req, hit, hit_pos, score, issue_type, item) and the columns
    ``norm``; the best hit has the largest score (ties: first request, first position).
    Scores of types add up, scores of items are their largest.
    """
    total = Window.partitionBy("req_item")
    share = F.col("norm") / F.sum("norm").over(total)
    step = hits.withColumns({"_share": share, "_n": F.count(F.lit(1)).over(total)})
    order = F.struct(F.col("score").alias("s"), (-F.col("req")).alias("r"), (-F.col("hit_pos")).alias("p"))
    lowest = F.struct(F.col("norm").alias("s"), F.col("req").alias("r"), F.col("hit_pos").alias("p"))
    score = F.sum("_share") if identity == "issue_type" else F.max("norm")
    grouped = step.groupBy("req_item", identity).agg(
        F.max_by("hit", order).alias("best_hit"),
        F.max_by("req", order).alias("best_req"),
        score.alias("f_0"),
        (1 / (1 + F.max_by("hit_pos", order))).alias("f_3"),
        F.max("norm").alias("f_26"),
        (1 / (1 + F.min_by("hit_pos", lowest))).alias("f_5"),
        F.min("norm").alias("f_27"),
        (F.count(F.lit(1)) / F.first("_n")).alias("f_7"),
        F.avg("norm").alias("f_28"),
    )
    place = F.row_number().over(Window.partitionBy("req_item").orderBy(F.bround("f_0", 9).desc(), identity))
    return grouped.withColumns({"f_1": 1.0 / place, "f_9": 1.0 / F.count(F.lit(1)).over(total)})


def with_field_terms(logs: DataFrame) -> DataFrame:
    """Adds ``<field>_terms`` for each text field that is compared, once a log."""
    for name in SIMILAR_FIELDS.values():
        if name in logs.columns:
            logs = with_terms(logs, name, f"{name}_terms")
    return logs.withColumn("only_numbers_values", values("only_numbers")) if "only_numbers" in logs.columns else logs


def pair_likeness(pairs: DataFrame, r: str = "r_", h: str = "h_") -> DataFrame:
    """The features of two logs that have no direction, from ``with_field_terms`` of both sides; fields that are not there give none."""
    out: dict[str, Column] = {}
    has = lambda *names: all(f"{s}{n}" in pairs.columns for s in (r, h) for n in names)
    equal = lambda n: ((F.trim(F.coalesce(f"{r}{n}", F.lit(""))) != "") & (F.col(f"{r}{n}") == F.col(f"{h}{n}"))).cast("double")
    for number, name in SIMILAR_FIELDS.items():
        if has(f"{name}_terms"):
            out[f"f_{number}"] = F.bround(similarity(F.col(f"{r}{name}_terms"), F.col(f"{h}{name}_terms"))["similarity"], 2)
    if has("message"):
        out["f_12"] = ((F.trim(f"{r}message") == "") & (F.trim(f"{h}message") == "")).cast("double")
    if has("only_numbers_values"):
        out["f_25"] = F.bround(overlap(F.col(f"{r}only_numbers_values"), F.col(f"{h}only_numbers_values")), 2)
    elif has("only_numbers"):
        out["f_25"] = F.bround(value_overlap(F.col(f"{r}only_numbers"), F.col(f"{h}only_numbers")), 2)
    if has("test_case_hash"):
        out["f_42"] = (F.col(f"{r}test_case_hash") == F.col(f"{h}test_case_hash")).cast("double")
    for number, name in ((52, "urls"), (55, "potential_status_codes")):
        if has(name):
            out[f"f_{number}"] = equal(name)
    if has("launch_name"):
        out["f_56"] = (F.lower(F.trim(f"{r}launch_name")) == F.lower(F.trim(f"{h}launch_name"))).cast("double")
    if has("launch_id"):
        out["f_57"] = (F.col(f"{r}launch_id") == F.col(f"{h}launch_id")).cast("double")
    return pairs.withColumns(out).drop(*[c for c in pairs.columns if c.endswith(("_terms", "_values"))])


def hit_features(pairs: DataFrame, now: Column, rate: float = 0.95, same_case: bool = False) -> DataFrame:
    """The features of a hit, beside those of ``pair_likeness``; with ``same_case`` all pairs are known to be of one test case each."""
    out: dict[str, Column] = {}
    if "h_is_auto_analyzed" in pairs.columns:
        out["f_35"] = (~F.col("h_is_auto_analyzed")).cast("double")
    if "f_42" in pairs.columns:
        out["f_43"] = F.col("f_42") if same_case else F.max("f_42").over(Window.partitionBy("req_item"))
    if "h_issue_type" in pairs.columns:
        for number, base in zip((48, 49, 50), CERTAIN_TYPES, strict=True):
            out[f"f_{number}"] = F.coalesce(F.lower("h_issue_type").startswith(base), F.lit(False)).cast("double")
    if "h_start_time" in pairs.columns:
        out["f_64"] = F.bround(S.age_decay(now, F.col("h_start_time"), rate), 2)
    return pairs.withColumns(out)


def pair_features(pairs: DataFrame, now: Column, rate: float = 0.95) -> DataFrame:
    """Features of the best pair: ``pairs`` has the request's fields as ``r_*`` and the hit's as ``h_*``."""
    return hit_features(pair_likeness(pairs), now, rate)


def rank_items(predictions: DataFrame) -> DataFrame:
    """(req_item, item, score, best_hit, rank): the mean probability of an item's logs, weighed by level and length.

    ``predictions`` has (req_item, item, hit, pos, probability, log_level, length).
    """
    longest = F.greatest(F.max("length").over(Window.partitionBy("req_item", "item")), F.lit(1))
    weighed = predictions.withColumn("w", S.log_weight(F.col("log_level"), F.col("length"), longest))
    grouped = weighed.groupBy("req_item", "item").agg(
        F.when(F.sum("w") > 0, F.sum(F.col("probability") * F.col("w")) / F.sum("w")).otherwise(F.lit(1.0)).alias("score"),
        F.max_by("hit", F.struct("w", (-F.col("pos")).alias("p"))).alias("best_hit"),
        F.min("pos").alias("first_pos"),
    )
    order = Window.partitionBy("req_item").orderBy(F.bround("score", 9).desc(), "first_pos", "item")
    return grouped.withColumn("rank", F.row_number().over(order) - 1).drop("first_pos")


def suggest(ranked: DataFrame, most: int = 3, least: float = 0.4) -> DataFrame:
    """The first items whose score reaches the bound; positions were given before."""
    return ranked.where((F.col("rank") < most) & (F.col("score") >= least))


def similarity_predictions(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """The model-free predictor: per request log and item the most similar hit, positive from ``least`` on.

    ``pairs`` has (req_item, req, item, hit, r_terms, h_terms), the latter from ``with_terms``.
    """
    return best_predictions(pairs.withColumn("probability", similarity(F.col("r_terms"), F.col("h_terms"))["similarity"]).drop("r_terms", "h_terms"), least)


def best_predictions(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Per request log and item the hit of the largest ``probability`` (ties: the smaller id)."""
    best = Window.partitionBy("req", "item").orderBy(F.col("probability").desc(), "hit")
    return scored.withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b").withColumn("label", (F.col("probability") >= least).cast("int"))


def patterns(named: DataFrame, least_share: float = 0.9, least_count: int = 5) -> DataFrame:
    """(pattern, total_count, percent, label) of exceptions that mostly mean one issue type.

    ``named`` has (exception, issue_type); items to investigate count in the total only.
    """
    base = named.withColumn("label", F.lower(F.substring("issue_type", 1, 2)))
    total = base.groupBy("exception").agg(F.count(F.lit(1)).alias("total_count"))
    typed = base.where("label <> 'ti'").groupBy("exception", "label").agg(F.count(F.lit(1)).alias("n"))
    share = typed.withColumn("percent", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("exception")), 2))
    return share.where((F.col("percent") >= least_share) & (F.col("n") >= least_count)).join(total, "exception").select(F.col("exception").alias("pattern"), "total_count", "percent", "label")


def unlabelled_patterns(named: DataFrame, least_count: int = 10) -> DataFrame:
    return named.groupBy(F.col("exception").alias("pattern")).agg(F.count(F.lit(1)).alias("total_count")).where(F.col("total_count") >= least_count)


def label_proportion(labels: DataFrame, label: str = "label") -> DataFrame:
    """The rarest label's count against the commonest's; 0 unless there are two labels with more than two rows each."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    low, high = F.min("n"), F.max("n")
    return counts.agg(F.when((F.count(F.lit(1)) >= 2) & (low > 2), F.bround(low / high, 3)).otherwise(F.lit(0.0)).alias("proportion"))
