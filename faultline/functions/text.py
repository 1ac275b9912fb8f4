"""Text rules as Spark columns; every function takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import patterns as P

NL = "\n"


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Applies regular expressions and their replacements one after another."""
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def removed(text: Column, patterns: list[str]) -> Column:
    return replaced(text, [(p, "") for p in patterns])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, NL)


def joined(lines: Column, by: str = NL) -> Column:
    return F.array_join(lines, by)


def is_filled(text: Column) -> Column:
    return text.rlike(r"\S")


def remove_starting_datetime(text: Column) -> Column:
    return removed(text, P.STARTING_DATETIME)


def remove_starting_level(text: Column) -> Column:
    return removed(text, P.STARTING_LEVEL)


def remove_starting_thread_id(text: Column) -> Column:
    return removed(text, P.STARTING_THREAD_ID)


def remove_starting_thread_name(text: Column) -> Column:
    return removed(text, P.STARTING_THREAD_NAME)


def delete_empty_lines(text: Column) -> Column:
    return joined(F.filter(lines_of(text), is_filled))


def count_lines(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(lines_of(text), is_filled))


def is_python_log(text: Column) -> Column:
    """The only file extension named anywhere is ``py``."""
    found = F.regexp_extract_all(text, F.lit(rf"\.({'|'.join(P.FILE_EXTENSIONS)})(?!\.)\b"), 1)
    return F.array_distinct(found) == F.array(F.lit("py"))


def is_message_start(text: Column) -> Column:
    """A call with a source reference that the text begins with (the extensions are alternatives of the whole pattern)."""
    pattern = rf"\w*\s*\(\s*.*\.{'|'.join(P.FILE_EXTENSIONS)}:\d+\s*\)"
    return text.rlike(pattern) & F.startswith(text, F.regexp_extract(text, pattern, 0))


def remove_numbers(text: Column) -> Column:
    """Whole numbers become a tag, other digits go."""
    return replaced(text, [(P.WHOLE_NUMBER, P.NUMBER_TAG), (P.DIGITS, "")])


def remove_bracketed(text: Column) -> Column:
    return F.regexp_replace(text, P.BRACKETED, "")


def blank_special_characters(text: Column) -> Column:
    return F.regexp_replace(text, P.SPECIAL_CHARACTERS, " ")


def split_words(text: Column, min_length: int = 0, unique: bool = True, split_urls: bool = True, to_lower: bool = True) -> Column:
    """Words without punctuation (dots stay inside a word) and stop words, in order."""
    punctuation = "!\"#$%&'()*+,-:;<=>?@[]^_`{|}~" + ("/\\" if split_urls else "")
    flat = F.translate(F.coalesce(text, F.lit("")), punctuation, " " * len(punctuation))
    flat = F.lower(flat) if to_lower else flat
    words = F.transform(F.split(flat, r"\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    kept = F.filter(words, lambda w: (w != "") & (F.length(w) >= min_length) & ~w.isin(P.STOP_WORDS))
    return F.array_distinct(kept) if unique else kept


def found_exceptions(text: Column, to_lower: bool = False) -> Column:
    """The distinct words that name an error, an exception or a failure."""
    ending = rf"\S{{3,}}(?:{'|'.join(P.EXCEPTION_ENDINGS)})(\s|$)"
    return F.filter(split_words(text, to_lower=to_lower), lambda w: F.lower(w).rlike(ending))


def status_codes(text: Column) -> Column:
    """All groups of the first match of each pattern on each line."""
    per_line = lambda line: F.array(*[F.regexp_extract(line, p, g) for p, n in zip(P.STATUS_CODES, P.STATUS_GROUPS, strict=True) for g in range(1, n + 1)])
    return F.filter(F.flatten(F.transform(lines_of(text), per_line)), lambda c: c != "")


def unique_status_codes(text: Column) -> Column:
    return F.array_distinct(status_codes(text))


def first_lines(text: Column, n: int) -> Column:
    return text if n < 0 else joined(F.slice(lines_of(text), 1, n)) if n else F.lit("")


def is_stack_line(text: Column) -> Column:
    """A line that is part of a stack trace rather than of the message."""
    plain = F.regexp_replace(text, P.IP_PORT, "")
    extensions = "|".join(rf"\.{e}(?!\.)\b" for e in P.FILE_EXTENSIONS)
    marks = plain.rlike(P.IP_PORT) | (plain != text) | plain.rlike(P.LINE_NUMBER_AT_END) | plain.rlike(P.LINE_WORD) | plain.rlike(f"(?i){extensions}")
    return ~is_message_start(text) & (marks | plain.rlike(P.CALL_AT) | plain.rlike(P.CALL_DOTTED))


def split_python_log(text: Column, keep: int = 1) -> Column:
    """(message, stack): a traceback word starts the stack, a line that names an exception ends it."""
    words = "|".join(P.TRACEBACK_WORDS)
    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("message"), F.array().cast("array<string>").alias("stack"))

    def step(state: Column, line: Column) -> Column:
        opens = F.lower(line).rlike(words)
        inside = F.when(opens, F.lit(True)).when(F.size(found_exceptions(line)) > 0, F.lit(False)).otherwise(state["inside"])
        grown = lambda to, when: F.when(when, F.array_append(state[to], line)).otherwise(state[to])
        return F.struct(inside.alias("inside"), grown("message", ~inside).alias("message"), grown("stack", inside).alias("stack"))

    parted = F.aggregate(lines_of(text), zero, step)
    return F.transform(F.array(parted), lambda p: _promoted(p["message"], p["stack"], -keep))[0]


def _promoted(message: Column, stack: Column, take: int) -> Column:
    """If no line is left for the message, the first (take > 0) or last lines of the stack are."""
    n = F.size(stack)
    if take > 0:
        moved, rest = F.slice(stack, 1, take), F.slice(stack, F.lit(take + 1), F.greatest(n - take, F.lit(0)))
    else:
        kept = F.greatest(n + take, F.lit(0))
        moved, rest = F.slice(stack, kept + 1, F.lit(-take)), F.slice(stack, F.lit(1), kept)
    empty = F.size(message) == 0
    return F.struct(joined(F.when(empty, moved).otherwise(message)).alias("message"), joined(F.when(empty, rest).otherwise(stack)).alias("stack"))


def split_message_and_stack(text: Column) -> Column:
    """(message, stack) of a log; up to two filled lines are all message."""
    lines = lines_of(text)
    parted = _promoted(F.filter(lines, lambda x: ~is_stack_line(x)), F.filter(lines, is_stack_line), 1)
    whole = F.struct(text.alias("message"), F.lit("").alias("stack"))
    return F.when(count_lines(text) <= 2, whole).when(is_python_log(text), split_python_log(text)).otherwise(parted)


def clean_html_tags(text: Column) -> Column:
    return replaced(text, [(P.STYLE_TAG, " "), (P.SCRIPT_TAG, " "), (P.HTML_TAGS, " ")])


def clean_html(text: Column) -> Column:
    """Cleans the line ranges from ``<html>`` to ``</html>``; a range that never ends stays as it is."""
    texts = lambda: F.array().cast("array<string>")
    zero = F.struct(F.lit(False).alias("inside"), texts().alias("out"), texts().alias("part"))

    def step(state: Column, line: Column) -> Column:
        inside = state["inside"] | line.rlike(P.HTML_START)
        part = F.when(inside, F.array_append(state["part"], line)).otherwise(state["part"])
        out = F.when(inside, state["out"]).otherwise(F.array_append(state["out"], line))
        ends = F.contains(line, F.lit(P.HTML_END))
        return F.struct((inside & ~ends).alias("inside"), F.when(ends, F.array_append(out, clean_html_tags(joined(part)))).otherwise(out).alias("out"), F.when(ends, texts()).otherwise(part).alias("part"))

    return delete_empty_lines(joined(F.aggregate(lines_of(text), zero, step, lambda s: F.concat(s["out"], s["part"]))))


def only_numbers(text: Column) -> Column:
    return joined(split_words(F.regexp_replace(text, r"[^\d ._]", ""), unique=False), " ")


def enrich_methods(text: Column) -> Column:
    """Long dotted names are followed by their last two parts and their last part; names with fewer parts first."""

    def enrich(line: Column) -> Column:
        parts = lambda w: F.split(w, r"\.")
        names = F.filter(split_words(line, to_lower=False), lambda w: (F.size(parts(w)) > 2) & (F.length(F.element_at(parts(w), -1)) > 3))
        ordered = F.array_sort(F.transform(names, lambda w, i: F.struct(F.size(parts(w)).alias("n"), i.alias("i"), w.alias("w"))))

        def follow(out: Column, name: Column) -> Column:
            p = parts(name["w"])
            full = F.concat_ws(" ", name["w"], joined(F.slice(p, -2, 2), "."), F.element_at(p, -1), F.lit(""))
            return F.regexp_replace(out, F.concat(F.lit(r"\b(?<!\.)"), name["w"], F.lit(r"(?!\.)\b")), full)

        return F.aggregate(ordered, line, follow)

    return joined(F.transform(lines_of(text), enrich))


def _capital_parts(word: Column) -> Column:
    """The word cut before and after every capitalised stretch."""
    cut = F.split(F.regexp_replace(word, r"([A-Z][^A-Z]+)", "\u0001$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, stripped), lambda x: x != "")


def test_item_name_words(text: Column) -> Column:
    words = split_words(F.translate(text, "-_", "  "), to_lower=False, unique=False)
    plain = lambda w: _capital_parts(w)
    dotted = lambda w: F.concat(F.filter(F.split(enrich_methods(w), " "), lambda x: is_filled(x)), _capital_parts(F.element_at(F.split(w, r"\."), -1)))
    return joined(F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit(".")), dotted(w)).otherwise(plain(w)))), " ")


def test_methods(text: Column) -> Column:
    """Test and step methods and test files named in a text, without those that look like exceptions; in order of finding."""
    found = F.concat(F.regexp_extract_all(text, F.lit(P.TEST_METHOD), 0), F.regexp_extract_all(text, F.lit(P.TEST_FILE), 0))
    return F.filter(F.array_distinct(found), lambda m: F.size(found_exceptions(m)) == 0)


def test_method_words(text: Column) -> Column:
    words = split_words(text, to_lower=False, unique=False)
    return joined(F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit(".")), F.array(w)).otherwise(_capital_parts(w)))), " ")


def defect_tokens(text: Column) -> Column:
    """Tokens of the defect model: words of three letters or more, then pairs of their underscore and capital parts."""

    none = F.array().cast("array<string>")
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def pairs(parts: Column, least: int) -> Column:
        two = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.lower(joined(F.slice(p, i, F.lit(2)), "")))
        return once(parts, lambda p: F.when(F.size(p) > 2, F.filter(two(p), lambda x: F.length(x) > least)).otherwise(none))

    def parted(word: Column, flat: Column) -> Column:
        own = F.when(F.length(flat) >= 3, F.array(F.lower(flat))).otherwise(none)
        capital = F.when(F.contains(word, F.lit(".")), none).otherwise(pairs(_capital_parts(flat), 3))
        return F.concat(own, pairs(F.split(word, "_"), -1), capital)

    def tokens(raw: Column) -> Column:
        return once(F.regexp_replace(raw, r"^\w\.", ""), lambda word: once(F.replace(word, F.lit("_"), F.lit("")), lambda flat: parted(word, flat)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[\w.]+"), 0), tokens))


def remove_uuids(text: Column) -> Column:
    return replaced(text, P.UUIDS)


def remove_hex(text: Column) -> Column:
    return replaced(text, P.HEX)


def tabs_to_lines(text: Column) -> Column:
    return F.translate(text, "\t", NL)


def unify_line_endings(text: Column) -> Column:
    return F.regexp_replace(text, P.LINE_ENDING, NL)


def unify_spaces(text: Column) -> Column:
    return replaced(text, P.SPACES)


def decode_urls(text: Column) -> Column:
    """Percent-decodes a text; if that changes it, brackets, ``#`` and ``%`` become spaces.  Malformed texts stay."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.when(decoded != text, F.regexp_replace(decoded, r"[(){}#%]", " ")).otherwise(text)


def remove_generated_parts(text: Column) -> Column:
    return replaced(text, P.GENERATED_PARTS)


def unique_lines(text: Column) -> Column:
    """The first of the lines that are equal but for outer space, without pointers to documentation."""
    texts = F.array().cast("array<string>")

    def step(state: Column, line: Column) -> Column:
        useless = F.lit(True)
        for word in P.DOCUMENTATION_WORDS:
            useless = useless & F.contains(F.lower(line), F.lit(word))
        skip = useless | F.array_contains(state["keys"], stripped(line))
        return F.when(skip, state).otherwise(F.struct(F.array_append(state["keys"], stripped(line)).alias("keys"), F.array_append(state["lines"], line).alias("lines")))

    return F.aggregate(lines_of(text), F.struct(texts.alias("keys"), texts.alias("lines")), step, lambda s: joined(s["lines"]))


def space_colons(text: Column) -> Column:
    return F.replace(text, F.lit(":"), F.lit(" : "))


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.URL), 0)


def extract_paths(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(P.PATH), 0), stripped)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def extract_params(text: Column) -> Column:
    """The distinct quoted texts, without their quotes."""
    inner = F.transform(F.regexp_extract_all(text, F.lit(P.QUOTED), 1), lambda q: stripped(F.regexp_extract(q, r"[^'\"]+", 0)))
    return F.array_distinct(F.filter(inner, lambda x: x != ""))


def build_url(base: Column, *parts: Column) -> Column:
    return F.concat_ws("/", base, *parts)


def remove_credentials(url: Column) -> Column:
    return F.regexp_replace(url, P.CREDENTIALS, "$1")


def enrich_exceptions(text: Column) -> Column:
    """Each word is followed by its last two dotted parts and its last part, where they are new."""
    words = F.split(text, " ")
    offered = F.flatten(F.transform(words, lambda w: F.array(w, joined(F.slice(F.split(w, r"\."), F.greatest(F.lit(-2), -F.size(F.split(w, r"\."))), 2), "."), F.element_at(F.split(w, r"\."), -1))))
    return joined(F.array_distinct(offered), " ")


def feature_range(text: Column) -> Column:
    """The ids in a list such as ``1-3,5``."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p, k: F.split(p, "-")[k].cast("int")
    return F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("-")), F.sequence(ends(p, 0), ends(p, 1))).otherwise(F.array(p.cast("int")))))


def blank_pieces(text: Column, pieces: Column) -> Column:
    """Every piece becomes a space, longer pieces first."""
    ordered = F.array_sort(F.transform(pieces, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.aggregate(ordered, text, lambda out, p: F.replace(out, p["w"], F.lit(" ")))


def min_should_match(share: Column) -> Column:
    return F.concat((share * 100).cast("int").cast("string"), F.lit("%"))


def remove_access_tokens(text: Column) -> Column:
    return replaced(text, P.ACCESS_TOKENS)


def remove_markdown_mark(text: Column) -> Column:
    return F.regexp_replace(text, P.MARKDOWN_MARK, "")


def replace_code_separators(text: Column) -> Column:
    return replaced(text, P.CODE_SEPARATORS)


def remove_webdriver_info(text: Column) -> Column:
    return replaced(text, P.WEBDRIVER)


def readable(text: Column) -> Column:
    return F.replace(text, F.lit(P.NUMBER_TAG), F.lit(P.READABLE_NUMBER))


def remove_urls(text: Column, urls: Column) -> Column:
    """Every URL becomes a tag, longer ones first."""
    ordered = F.array_sort(F.transform(F.array_distinct(urls), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.aggregate(ordered, text, lambda out, u: F.replace(out, u["w"], F.lit(P.URL_TAG)))


def similarity_words(text: Column) -> Column:
    """Lower-case words without punctuation and stop words, cut at capitals, nouns in the singular."""
    flat = replaced(F.regexp_replace(F.coalesce(text, F.lit("")), P.SIMILARITY_SPECIALS, " "), P.CAMEL)
    words = F.filter(F.split(F.lower(flat), r"\s+"), lambda w: (w != "") & ~w.isin(P.STOP_WORDS))
    return F.transform(words, singular)


def singular(word: Column) -> Column:
    """A rule for plural nouns: -ies to -y, -xes, -ches, -shes, -zes without -es, else without a last -s; not after s, u or i."""
    ends = lambda *tails: reduce(or_, [F.endswith(word, F.lit(t)) for t in tails])
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when((F.length(word) <= 3) | ~ends("s") | ends("ss", "us", "is"), word)
        .when(ends("ies"), F.concat(cut(3), F.lit("y")))
        .when(ends("xes", "ches", "shes", "zes"), cut(2))
        .otherwise(cut(1))
    )


def lower_issue_prefix(issue_type: Column) -> Column:
    return F.concat(F.lower(F.substring(issue_type, 1, 2)), F.substring(issue_type, 3, 1 << 20))


def normal_issue(issue_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(issue_type)), F.lit(""))


def base_issue(issue_type: Column) -> Column:
    """The two letters of plain types such as ``pb001``; other types as they are."""
    clean = normal_issue(issue_type)
    return F.when(clean.rlike(r"^[a-z]{2}\d{0,3}$"), F.substring(clean, 1, 2)).otherwise(clean)


def sorted_words(text: Column) -> Column:
    return joined(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def message_for_clustering(text: Column, n_lines: int, clean_numbers: bool, keep_structure: bool = False) -> Column:
    """The text by which messages are clustered; null for empty messages.

    Numbers are cleaned but for the status codes, which are hidden behind marks of their
    own meanwhile.
    """
    codes = unique_status_codes(text)
    plain = remove_starting_datetime(text)
    if clean_numbers:
        marks = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.concat(F.lit("#&"), F.repeat(F.lit("#"), i + 1), F.lit("&#")).alias("mark")))
        hidden = F.aggregate(marks, plain, lambda out, m: F.regexp_replace(out, F.concat(F.lit(r"\b"), m["code"], F.lit(r"\b")), m["mark"]))
        plain = F.aggregate(marks, remove_numbers(hidden), lambda out, m: F.replace(out, m["mark"], m["code"]))
    short = first_lines(delete_empty_lines(plain), n_lines)
    if not keep_structure:
        words = split_words(short, min_length=2, unique=False, to_lower=False)
        short = F.when(F.size(words) == 1, F.concat(words[0], F.lit(" error"))).otherwise(joined(words, " "))
    return F.when(F.length(text) > 0, short)


def unified_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def stripped_path(path: Column) -> Column:
    """Without white space around it, slashes at its end, and then backslashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), "/+$", ""), r"\\+$", "")
