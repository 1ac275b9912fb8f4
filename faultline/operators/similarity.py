"""Text similarity: cosine of word and word-pair counts, overlap of values, and dedupes built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import similarity_words

#: Similarities are rounded to this many places, half to even, so that equal inputs compare equal anywhere.
PLACES = 6


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it; in a lambda a plain column expression is computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(words: Column) -> Column:
    """Words and neighbouring pairs of words."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return bound(words, lambda w: F.when(F.size(w) >= 2, F.concat(w, pairs(w))).otherwise(w))


def counted(items: Column) -> Column:
    """item -> count, as a map."""

    def entries(ordered: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ordered))
        return F.transform(starts, lambda s, k: F.struct(F.get(ordered, s).alias("k"), (end(k) - s).alias("v")))

    def runs(ordered: Column) -> Column:
        places = F.transform(ordered, lambda _, i: i)
        return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    return F.map_from_entries(bound(F.array_sort(items), lambda o: bound(runs(o), lambda starts: entries(o, starts))))


def repeats(items: Column) -> Column:
    """item -> count of the items that occur more than once, as a map; null if there is none."""
    again = lambda o: F.filter(o, lambda t, i: (i > 0) & (t == F.get(o, i - 1)))
    times = lambda e: F.transform(F.array_distinct(e), lambda t: F.struct(t.alias("k"), (F.size(F.filter(e, lambda x: x == t)) + 1).cast("long").alias("v")))
    found = bound(bound(F.sort_array(items), again), times)
    return F.when(F.size(F.array_distinct(items)) < F.size(items), F.map_from_entries(found))


def with_terms(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the terms of a text, the counts of those that it repeats, their squared norm, and the raw text if it has no terms; computed once per text.

    Terms are 64-bit hashes, which are small to shuffle and quick to intersect; two terms of one hash count as one.
    """
    step = df.withColumn("_w", F.transform(terms(similarity_words(F.col(text))), lambda t: F.xxhash64(t))).withColumns({"_t": F.array_distinct("_w"), "_m": repeats(F.col("_w"))})
    norm = F.size("_t") + F.aggregate(F.coalesce(F.map_values("_m"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, v: a + v * v - 1)
    raw = F.when(F.size("_t") == 0, F.col(text))
    return step.withColumn(out, F.struct(raw.alias("raw"), F.col("_t").alias("terms"), F.col("_m").alias("repeats"), norm.alias("norm"))).drop("_w", "_t", "_m")


def similarity(a: Column, b: Column) -> Column:
    """(similarity, both_empty) of two ``with_terms`` columns.

    Two blank raw texts are both empty with similarity 0; if only stop words are left
    of both, the raw texts decide; if of one, 0; else the cosine of the term counts.
    """
    blank = lambda x: F.trim(F.coalesce(x["raw"], F.lit(""))) == ""
    times = lambda x, t: F.coalesce(F.try_element_at(x["repeats"], t), F.lit(1).cast("long"))
    shared = F.array_intersect(a["terms"], b["terms"])
    dot = F.when(a["repeats"].isNull() & b["repeats"].isNull(), F.size(shared).cast("long")).otherwise(F.aggregate(shared, F.lit(0).cast("long"), lambda s, t: s + times(a, t) * times(b, t)))
    none_a, none_b = F.size(a["terms"]) == 0, F.size(b["terms"]) == 0
    both = none_a & none_b & blank(a) & blank(b)
    value = (
        F.when(both, F.lit(0.0))
        .when(none_a & none_b, (a["raw"] == b["raw"]).cast("double"))
        .when(none_a | none_b, F.lit(0.0))
        .otherwise(F.bround(dot / F.sqrt(a["norm"].cast("double") * b["norm"]), PLACES))
    )
    return F.struct(value.alias("similarity"), both.alias("both_empty"))


def values(text: Column) -> Column:
    """The values of a list, each with its number among equal ones, so that sets of them meet as often as the values do; case does not matter."""
    found = F.transform(F.filter(F.split(text, " "), lambda v: F.trim(v) != ""), lambda v: F.lower(F.trim(v)))
    return bound(found, lambda x: F.transform(x, lambda v, i: F.concat(v, F.lit(" "), F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda e: e == v)).cast("string"))))


def overlap(x: Column, y: Column) -> Column:
    """(common / longest) x (1 - missing / longest) of two ``values`` columns."""
    common, longest = F.size(F.array_intersect(x, y)), F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(common / longest * (1 - (longest - common) / longest))


def value_overlap(a: Column, b: Column) -> Column:
    """``overlap`` of two lists of values; counts matter, case does not."""
    return overlap(values(a), values(b))


def last_unique(texts: DataFrame, threshold: float) -> DataFrame:
    """(grp, idx) of the texts kept in each group: of each text not chosen yet, the last one like it; and the last text.

    ``texts`` has (grp, idx, text) with idx from 0.  Terms are weighed by their inverse
    frequency in the group; texts without terms are like nothing.  Terms are 64-bit hashes,
    as in ``with_terms``.  Spark estimates them by the size of the files, far too low, so
    the join is told to sort: it must not collect them in the driver to broadcast them.
    """
    hashed = lambda words: F.transform(terms(words), lambda t: F.xxhash64(t))
    sized = texts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    tf = sized.select("grp", "idx", "n", F.explode(counted(hashed(F.filter(F.split("text", r"\W+"), lambda w: w != "")))).alias("term", "tf"))
    weighed = tf.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.count(F.lit(1)).over(Window.partitionBy("grp", "term")))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("grp", "idx")))
    unit = weighed.withColumn("norm", norm).select("grp", "idx", "term", (F.col("w") / F.col("norm")).alias("w"))
    later = unit.select("grp", "term", F.col("idx").alias("j"), F.col("w").alias("v"))
    near = unit.join(later.hint("merge"), ["grp", "term"]).where("idx < j").groupBy("grp", "idx", "j").agg(F.bround(F.sum(F.col("w") * F.col("v")), PLACES).alias("s")).where(F.col("s") >= threshold)
    last = near.groupBy("grp", "idx").agg(F.max("j").alias("last"))
    folded = (
        texts.select("grp", "idx").join(last, ["grp", "idx"], "left").groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("last", "idx").alias("last")))).alias("all"))
        .withColumn("kept", F.aggregate(F.slice("all", F.lit(1), F.size("all") - 1), F.array(F.size("all") - 1), lambda kept, e: F.when(F.array_contains(kept, e["idx"]), kept).otherwise(F.array_union(kept, F.array(e["last"])))))
    )
    return folded.select("grp", F.explode("kept").alias("idx"))


def best_request_log(pairs: DataFrame) -> DataFrame:
    """Each hit with the request log it is most like (above zero; ties: the first): ``pairs`` has (hit, req_order, similarity)."""
    order = Window.partitionBy("hit").orderBy(F.col("similarity").desc(), "req_order")
    return pairs.where("similarity > 0").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dedupe_results(results: DataFrame, fields: list[str], threshold: float = 0.98) -> DataFrame:
    """Drops a result that equals a kept earlier one of its group and issue type in all fields.

    ``results`` has (grp, pos, issue_type, fields); in each field two results are alike
    by ``similarity`` or by being empty both.  A dropped result drops no others.
    """
    step = results
    for f in fields:
        step = with_terms(step, f, f"_{f}")
    a = step.select("grp", "issue_type", F.col("pos").alias("i"), *[F.col(f"_{f}").alias(f"a_{f}") for f in fields])
    b = step.select("grp", "issue_type", F.col("pos").alias("j"), *[F.col(f"_{f}").alias(f"b_{f}") for f in fields])
    alike = F.lit(True)
    for f in fields:
        s = similarity(F.col(f"a_{f}"), F.col(f"b_{f}"))
        alike = alike & (s["both_empty"] | (s["similarity"] >= threshold))
    near = a.join(b, ["grp", "issue_type"]).where("i < j").where(alike).groupBy("grp", F.col("j").alias("pos")).agg(F.collect_set("i").alias("twins"))
    rows = results.select("grp", "pos").join(near, ["grp", "pos"], "left").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("twins", F.array().cast("array<int>")).alias("twins")))).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<int>"), lambda k, e: F.when(F.arrays_overlap(k, e["twins"]), k).otherwise(F.array_append(k, e["pos"])))
    return results.join(rows.select("grp", F.explode(kept).alias("pos")), ["grp", "pos"], "left_semi")
