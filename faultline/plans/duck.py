"""Pieces of DuckDB SQL, written for its own functions, that say what the column functions should give."""

from __future__ import annotations

import re

from faultline.functions import patterns as P


def lit(text: str) -> str:
    """A string literal; control characters through ``chr``."""
    parts = re.split(r"([\n\t])", text)
    return " || ".join(f"chr({ord(p)})" if p in "\n\t" else "'" + p.replace("'", "''") + "'" for p in parts if p) or "''"


def sub(text: str, pattern: str, by: str = "") -> str:
    flags = "g"
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], "gi"
    by = re.sub(r"\$(\d)", r"\\\1", by)
    return f"regexp_replace({text}, {lit(pattern.replace(chr(92) + 'h', ' ' + chr(92) + 't'))}, {lit(by)}, '{flags}')"


def subs(text: str, pairs: list) -> str:
    for pair in pairs:
        text = sub(text, *(pair if isinstance(pair, tuple) else (pair,)))
    return text


def lines(text: str) -> str:
    return f"string_split({text}, chr(10))"


def join(items: str, by: str = "\n") -> str:
    return f"array_to_string({items}, {lit(by)})"


def filled(name: str) -> str:
    return f"regexp_matches({name}, '\\S')"


def no_empty_lines(text: str) -> str:
    return join(f"list_filter({lines(text)}, lambda l: {filled('l')})")


def distinct(items: str) -> str:
    """First occurrences, in order."""
    return f"list_transform(list_filter(list_zip({items}, range(1, len({items}) + 1)), lambda p: list_position({items}, p[1]) = p[2]), lambda p: p[1])"


def stop_words() -> str:
    return "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"


def words(text: str, min_length: int = 0, unique: bool = True, urls: bool = True, lower: bool = True) -> str:
    marks = "!\"#$%&'()*+,-:;<=>?@[]^_`{|}~" + ("/\\" if urls else "")
    flat = f"translate({text}, {lit(marks)}, {lit(' ' * len(marks))})"
    flat = f"lower({flat})" if lower else flat
    cut = f"list_transform(string_split_regex({flat}, '\\s+'), lambda w: regexp_replace(w, '^\\.+|\\.+$', '', 'g'))"
    kept = f"list_filter({cut}, lambda w: w <> '' AND length(w) >= {min_length} AND NOT list_contains({stop_words()}, w))"
    return distinct(kept) if unique else kept


def exceptions(text: str) -> str:
    return f"list_filter({words(text, lower=False)}, lambda w: regexp_matches(lower(w), '\\S{{3,}}(error|exception|failure)(\\s|$)'))"


def numbers_removed(text: str) -> str:
    return subs(text, [(P.WHOLE_NUMBER, P.NUMBER_TAG), (P.DIGITS, "")])


def similarity_words(text: str) -> str:
    flat = f"lower({subs(sub(text, P.SIMILARITY_SPECIALS, ' '), P.CAMEL)})"
    kept = f"list_filter(string_split_regex({flat}, '\\s+'), lambda w: w <> '' AND NOT list_contains({stop_words()}, w))"
    noun = (
        "CASE WHEN length(w) <= 3 OR regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') "
        "WHEN regexp_matches(w, '(x|ch|sh|z)es$') THEN regexp_replace(w, 'es$', '') ELSE regexp_replace(w, 's$', '') END"
    )
    return f"list_transform({kept}, lambda w: {noun})"


def hex_modulus(digits: str, length: int, modulus: int) -> str:
    """The hexadecimal digits as a number, modulo ``modulus``."""
    values = f"list_transform(range(1, {length + 1}), lambda i: CAST(instr('0123456789abcdef', substr({digits}, i, 1)) - 1 AS HUGEINT))"
    return f"CAST(list_reduce({values}, lambda a, c: (a * 16 + c) % {modulus}) AS BIGINT)"


def bigrams(words: str) -> str:
    return f"CASE WHEN len({words}) >= 2 THEN list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]) ELSE [array_to_string({words}, ' ')] END"
