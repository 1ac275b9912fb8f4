"""Quality rules whose cutoffs carry a bound on wrongly rejected documents.

Every statistic is computed inside its row with array functions, so the text is
never shuffled.  Cutoffs are chosen on a labelled holdout: the exact binomial tail says
how many clean holdout documents of a stratum all rules together may reject so that
their joint false-rejection rate is at most ``max_false_rejection``, at a confidence
that is Bonferroni-corrected for the strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import stored

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"

#: Fixed rules of the base filter.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Rule -> (score that grows with badness).  Names are columns of ``quality_stats``.
RULES = {
    "symbol_share": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "long_word_mean": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "few_words": lambda c: F.lit(1.0) / F.greatest(c("n_words"), F.lit(1)),
}


def quality_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the word, symbol, line and repetition counts of each row's whole text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.withColumn("__rules_w", F.array_remove(F.split(text, WORD_BREAK), ""))
    hashed = words.withColumns(
        {
            "n_words": F.size("__rules_w").cast("long"),
            "__rules_h": F.transform("__rules_w", lambda w: F.xxhash64(w)),
            "word_chars": F.char_length(F.array_join("__rules_w", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long"),
            "__rules_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        }
    ).drop("__rules_w")
    h = F.col("__rules_h")
    five = F.when(
        F.size(h) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])),
    ).otherwise(F.array().cast("array<bigint>"))
    windows = hashed.withColumns(
        {
            "__rules_five": five,
            "n_lines": F.size("__rules_lines").cast("long"),
            "n_dup_lines": (F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines"))).cast("long"),
        }
    ).drop("__rules_h", "__rules_lines")
    # Positions of windows that occur twice, found next to each other after sorting (hash, position); most rows have none.
    g = F.col("__rules_five")
    ordered = F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    sorted_rows = windows.withColumn("__rules_s", ordered).drop("__rules_five")
    s = F.col("__rules_s")
    twice = F.filter(s, lambda e, k: (e["x"] == F.get(s, k + 1)["x"]) | ((k > 0) & (e["x"] == F.get(s, k - 1)["x"])))
    at = sorted_rows.withColumn("__rules_at", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(twice, lambda e: e.isNotNull()), lambda e: e["i"])))).drop("__rules_s")
    p = F.col("__rules_at")
    covered = F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__rules_at")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _log_factorial(x: Column) -> Column:
    """ln(x!), by Stirling's series eight places further up, where it is exact to ten digits."""
    z = x.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    passed = F.lit(1.0)
    for k in range(1, 9):
        passed = passed * (x + k)
    return series - F.log(passed)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), exactly, by the term ratio from the largest term down.

    Terms are summed relative to the term at k: for k below the mean they fall off
    towards zero, so the sum stays in range however large n is, and those more than
    forty roots of k away are below any double.
    """
    odds = rate / (1 - rate)
    log_choose = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    log_top = log_choose + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    last = F.greatest(F.lit(1).cast("long"), k - 50 - F.ceil(40 * F.sqrt(k)))
    ratios = F.aggregate(
        F.when(k >= 1, F.reverse(F.sequence(last, k))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: F.struct((a["sum"] + a["term"] * j / ((n - j + 1) * odds)).alias("sum"), (a["term"] * j / ((n - j + 1) * odds)).alias("term")),
        lambda a: a["sum"],
    )
    return F.least(F.lit(1.0), F.exp(log_top + F.log(ratios)))


def risk_controlled_cutoffs(holdout: DataFrame, stratum: str, rules: list[str], max_false_rejection: float = 0.005, confidence: float = 0.95, n_cutoffs: int = 64) -> DataFrame:
    """(stratum, rule, cutoff, n_clean, n_rejected, tail): per rule and stratum the most severe admitted cutoff.

    ``holdout`` has one row per labelled document: the stratum, a boolean ``clean``
    and one score column per rule.  A document is rejected when a score exceeds its
    rule's cutoff.  The clean rows of a stratum are cut one after the other along the
    rules, so what lies beyond the cutoffs consists of statistically equivalent blocks:
    K blocks together reject more than ``max_false_rejection`` of all clean documents
    with probability P(X < K), X binomial over the clean rows, however the rules
    depend on each other.  The largest K whose probability is at most the stratum's
    level is dealt to the rules in turn, and a rule with j blocks may reject at most
    j - 1 clean rows.  K depends on the number of rows alone, so the cutoffs tried are
    no tests of their own; ``1 - confidence`` is shared by the strata that could prove
    the bound by themselves, and any other stratum admits no cutoff.
    """
    budget = max_false_rejection / len(rules)
    grid = [1 - budget * (n_cutoffs - 1 - i) / (n_cutoffs - 1) for i in range(n_cutoffs)]
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("place"), F.col(r).cast("double").alias("score")) for k, r in enumerate(rules)])
    long = holdout.where("clean").select(F.col(stratum).alias("stratum"), F.explode(pairs).alias("e")).select("stratum", "e.*")
    cuts = long.groupBy("stratum", "rule", "place").agg(F.count(F.lit(1)).alias("n_clean"), F.array_distinct(F.percentile_approx("score", grid, 20_000)).alias("cuts"))
    passed = (
        long.join(F.broadcast(cuts.select("stratum", "rule", "cuts")), ["stratum", "rule"])  # one row per stratum and rule
        .select("stratum", "rule", F.explode(F.filter("cuts", lambda c: c < F.col("score"))).alias("cutoff"))
        .groupBy("stratum", "rule", "cutoff")
        .agg(F.count(F.lit(1)).alias("n_rejected"))
    )
    sizes = cuts.where("place = 0").select("stratum", "n_clean")
    able = sizes.where(F.pow(F.lit(1 - max_false_rejection), F.col("n_clean")) <= 1 - confidence)
    level = able.agg((F.lit(1 - confidence) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("_level"))
    most = F.floor(F.col("n_clean") * max_false_rejection)
    steps = F.sequence(F.lit(1).cast("long"), F.lit(n_cutoffs).cast("long"))
    blocks = F.array_union(steps, F.transform(steps, lambda i: F.floor(F.col("n_clean") * max_false_rejection * i / n_cutoffs)))
    proved = able.select("stratum", "n_clean", F.explode(F.filter(blocks, lambda k: (k >= 1) & (k <= most))).alias("blocks"))
    proved = proved.withColumn("tail", binomial_tail(F.col("blocks") - 1, F.col("n_clean"), max_false_rejection)).join(F.broadcast(level)).where("tail <= _level")  # one row
    granted = proved.groupBy("stratum").agg(F.max(F.struct("blocks", "tail")).alias("g")).select("stratum", "g.*")
    candidates = cuts.select("stratum", "rule", "place", "n_clean", F.explode("cuts").alias("cutoff"))
    tests = candidates.join(passed, ["stratum", "rule", "cutoff"], "left").withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0)).cast("long"))
    own = F.floor((F.col("blocks") + len(rules) - 1 - F.col("place")) / len(rules))
    best = Window.partitionBy("stratum", "rule").orderBy("cutoff")
    admitted = tests.join(F.broadcast(granted), "stratum").where(F.col("n_rejected") < own)  # one row per stratum
    admitted = admitted.select("stratum", "rule", "cutoff", "n_clean", "n_rejected", "tail")
    return admitted.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", clean_col: str = "quality", keep_text: bool = False, **control) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``) with the counts, scores, ``base_failed``, ``failed_rules`` and ``kept``.

    ``labels`` has (id, clean flag 0/1).  Null texts have no words and fail the base
    rule; null strata form one stratum; an id counts once in the holdout, however often
    it is labelled or has rows, and is clean if all its labels say so.  Rows may repeat,
    and each is judged by itself.  Extra columns of ``labels`` are not read; columns of
    ``docs`` with the name of a result are replaced.  With no labels nothing beyond the
    base rule rejects.  A text is worked on in one row, so the longest text bounds a
    task's memory.
    """
    stats = quality_stats(docs, text_col)
    stats = stats if keep_text else stats.drop(text_col)
    stats = stats.withColumns({r: f(F.col).cast("double") for r, f in RULES.items()})
    stats = stats.withColumns({"__rules_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("")), "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words"))})
    stats = stored(stats, "quality_stats")
    flags = labels.where(F.col(clean_col).isNotNull()).groupBy(F.col(id_col).alias("__rules_label_id")).agg(F.min(F.col(clean_col) == 1).alias("clean"))
    scored = stats.where("not base_failed").select(F.col(id_col).alias("__rules_label_id"), F.struct("__rules_stratum", *RULES).alias("__rules_scores"))
    holdout = scored.join(flags, "__rules_label_id").groupBy("__rules_label_id", "clean").agg(F.max("__rules_scores").alias("__rules_scores")).select("clean", "__rules_scores.*")
    cutoffs = risk_controlled_cutoffs(holdout, "__rules_stratum", list(RULES), **control)
    per_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__rules_cuts")).withColumnRenamed("stratum", "__rules_of")  # at most one entry per rule
    judged = stats.join(F.broadcast(per_stratum), F.col("__rules_stratum") == F.col("__rules_of"), "left").drop("__rules_of", "__rules_stratum")
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.element_at("__rules_cuts", r), F.lit(r)) for r in RULES]))
    judged = judged.withColumn("failed_rules", F.when(F.col("__rules_cuts").isNull(), F.array().cast("array<string>")).otherwise(broken)).drop("__rules_cuts")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
