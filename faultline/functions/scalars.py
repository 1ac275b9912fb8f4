"""Number, date, array and map rules as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.patterns import ERROR_LEVEL
from faultline.functions.text import split_words

DAY_SECONDS = 86400
#: How many words a text may miss, by the bands of the share asked for.
MISSED_BY_SHARE = [(0.95, 0.99, 1), (0.9, 0.95, 2), (0.8, 0.9, 3)]
HASH_MODULUS = 10**16


def adaptive_threshold(size: Column, share: float, least: float = 0.8) -> Column:
    """A similarity threshold that lets a short text miss whole words: (size - k) / size if that stays above ``least``."""
    missed = next((k for low, high, k in MISSED_BY_SHARE if low <= share < high or share == high == 0.99), 0)
    if not missed:
        return F.lit(float(share))
    candidate = (size - missed) / size
    return F.when((size > 0) & (candidate >= least), F.least(F.lit(float(share)), F.round(candidate, 4))).otherwise(F.lit(float(share)))


def text_threshold(text: Column, share: float, least: float = 0.8) -> Column:
    return adaptive_threshold(F.size(split_words(text)), share, least)


def log_weight(level: Column, length: Column, longest: Column) -> Column:
    """Weight of a log in its item: its level against an error's, times its length against the longest."""
    return F.when(longest > 0, level / F.lit(float(ERROR_LEVEL)) * length / longest).otherwise(F.lit(0.0))


def whole_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def real_id(stored: Column) -> Column:
    """The log id without the ``_m`` of merged logs."""
    return F.regexp_replace(stored, "_m$", "").cast("bigint")


def is_clustered_with_numbers(cluster_id: Column) -> Column:
    return F.pmod(F.pmod(cluster_id, F.lit(10)), F.lit(2)) == 1


def first_largest(scores: Column) -> Column:
    """The place (from 0) of the first largest score above zero, else null."""
    return F.when(F.array_max(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def decay(days: Column, rate: float, scale: float = 7.0) -> Column:
    """``rate`` to the power of days / scale."""
    return F.exp(F.lit(math.log(rate)) * days / scale)


def age_decay(now: Column, then: Column, rate: float) -> Column:
    """The decay over whole days between two times, whichever is earlier."""
    return decay(F.floor(F.abs(F.unix_timestamp(now) - F.unix_timestamp(then)) / DAY_SECONDS), rate)


def relevance_decay(now: Column, start: Column, rate: float, floor: float, offset_days: float = 1.0) -> Column:
    """Score factor of an item's age beyond the offset, not below ``floor``."""
    days = F.greatest(F.abs(F.unix_timestamp(now) - F.unix_timestamp(start)) / DAY_SECONDS - offset_days, F.lit(0.0))
    return F.greatest(decay(days, rate), F.lit(floor))


def hex_modulus(digits: Column, modulus: int) -> Column:
    """A hexadecimal string modulo a number, digit by digit, so that it never overflows."""
    places = F.split(digits, "")
    return F.aggregate(
        F.filter(places, lambda c: c != ""),
        F.lit(0).cast("decimal(38,0)"),
        lambda a, c: ((a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % modulus).cast("decimal(38,0)"),
        lambda a: a.cast("bigint"),
    )


def text_hash(text: Column) -> Column:
    """SHA-1 of a text modulo 10**16: a stable id."""
    return hex_modulus(F.sha1(text), HASH_MODULUS)


def hash_bucket(text: Column) -> Column:
    """The bucket (0 to 99) of a text, by its MD5."""
    return hex_modulus(F.md5(text), 100)


def synthetic_item_id(base: Column, index: Column) -> Column:
    """Ids of made-up items: negative, apart for each base and index."""
    return -(F.abs(base) * 10 + index + 1)


def timestamp_of(parts: Column) -> Column:
    """[year, month, day, hour, minute, second, ...] as a timestamp; further slots are ignored."""
    return F.make_timestamp_ntz(*[F.get(parts, k) for k in range(6)])


def time_parts(time: Column) -> Column:
    """The seven numbers of a time, year to microseconds."""
    return F.array(F.year(time), F.month(time), F.dayofmonth(time), F.hour(time), F.minute(time), F.second(time), F.pmod(F.unix_micros(time), F.lit(1_000_000)).cast("int"))


def normal_timestamp(text: Column) -> Column:
    """ISO times in UTC without zone; day and second formats; null if nothing fits."""
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    tried = [F.try_to_timestamp(zoned, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(*tried)


def format_timestamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of words; a single word (or none) stands alone."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " "))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array(F.array_join(words, " ")))


def history_negatives(history: Column, most: int = 2) -> Column:
    """The last different types an item had before its present one, newest first."""
    types = F.filter(F.reverse(F.transform(history, lambda h: h["issue_type"])), lambda t: t.isNotNull())
    return F.slice(F.array_distinct(F.filter(types, lambda t: t != F.get(history, F.size(history) - 1)["issue_type"])), 1, most)


def update_map(raw_json: Column) -> Column:
    """{id: type or {issueType, issueComment, timestamp}} as a map of structs; blank types are dropped."""
    parsed = F.from_json(raw_json, "map<string,string>")
    shape = "struct<issueType:string,issueComment:string,timestamp:array<int>>"
    entries = F.transform(
        F.map_entries(parsed),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(e["value"].startswith("{"), F.from_json(e["value"], shape.removeprefix("struct<").removesuffix(">").replace(":", " "))).otherwise(F.struct(e["value"].alias("issueType"), F.lit(None).cast("string").alias("issueComment"), F.lit(None).cast("array<int>").alias("timestamp"))).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(F.trim(e["value"]["issueType"]), F.lit("")) != ""))
