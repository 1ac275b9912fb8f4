"""DuckDB SQL of the text rules that need lookarounds, states or several steps.

DuckDB's regular expressions look neither ahead nor behind; the SQL says the same
with boundaries that are matched, with pieces of a split text, or with folds over lines.
"""

from __future__ import annotations

from faultline.functions import patterns as P
from faultline.operators.prepare import LINE_FIELDS
from faultline.plans import duck as D
from faultline.plans.logs import ORACLE_LOGS

_EXTENSIONS = "|".join(P.FILE_EXTENSIONS)
_TRIM = [(r"^\s+|\s+$", "")]
_NAME = "[a-zA-Z0-9_-]+"


def message_start(t: str) -> str:
    pattern = D.lit(rf"\w*\s*\(\s*.*\.{_EXTENSIONS}:\d+\s*\)")
    return f"(regexp_matches({t}, {pattern}) AND starts_with({t}, regexp_extract({t}, {pattern})))"


def stack_line(line: str) -> str:
    plain = D.sub(line, P.IP_PORT)
    seen = [
        f"regexp_matches({plain}, {D.lit(P.IP_PORT)})",
        f"{plain} <> {line}",
        rf"regexp_matches({plain}, ':\d+\)?\]?\r?$')",
        rf"regexp_matches({plain}, 'line\s*\d+\s*(, in|,in|\r?$)', 'i')",
        rf"regexp_matches({plain}, '\.({_EXTENSIONS})($|[^\w.])', 'i')",
        f"regexp_matches({plain}, {D.lit(P.CALL_AT)})",
        f"regexp_matches({plain}, {D.lit(P.CALL_DOTTED)})",
    ]
    return f"(NOT {message_start(line)} AND ({' OR '.join(seen)}))"


def python_log(t: str) -> str:
    return rf"(list_distinct(regexp_extract_all({t} || ' ', '\.({_EXTENSIONS})\b[^.]', 1)) = ['py'])"


def count_lines(t: str) -> str:
    return f"CAST(len(list_filter({D.lines(t)}, lambda l: {D.filled('l')})) AS INTEGER)"


def _picked(flags: str, want: str) -> str:
    return f"list_transform(list_filter(list_zip(ls, {flags}), lambda p: p[2] = {want}), lambda p: p[1])"


def parted(source: str) -> str:
    """CTEs from ``source`` (log_id, t) to ``parted`` (log_id, t, message, stack) and ``parted_python`` of the same columns."""
    words = "|".join(P.TRACEBACK_WORDS)
    return f"""
part_lines AS (SELECT log_id, t, {D.lines('t')} AS ls FROM {source}),
part_marks AS (SELECT *, list_transform(ls, lambda l: {stack_line('l')}) AS st,
  list_transform(ls, lambda l: CASE WHEN regexp_matches(lower(l), '{words}') THEN 1 WHEN len({D.exceptions('l')}) > 0 THEN 0 END) AS ev FROM part_lines),
part_states AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: coalesce(list_filter(list_slice(ev, 1, i), lambda e: e IS NOT NULL)[-1], 0) = 1) AS py FROM part_marks),
part_lists AS (SELECT log_id, t, {_picked('st', 'false')} AS m, {_picked('st', 'true')} AS s, {_picked('py', 'false')} AS pm, {_picked('py', 'true')} AS ps FROM part_states),
parted_python AS (SELECT log_id, t, {D.join('CASE WHEN len(pm) = 0 THEN list_slice(ps, greatest(len(ps), 1), len(ps)) ELSE pm END')} AS message,
  {D.join('CASE WHEN len(pm) = 0 THEN list_slice(ps, 1, len(ps) - 1) ELSE ps END')} AS stack FROM part_lists),
parted AS (SELECT l.log_id, l.t,
  CASE WHEN {count_lines('l.t')} <= 2 THEN l.t WHEN {python_log('l.t')} THEN p.message ELSE {D.join('CASE WHEN len(m) = 0 THEN list_slice(s, 1, 1) ELSE m END')} END AS message,
  CASE WHEN {count_lines('l.t')} <= 2 THEN '' WHEN {python_log('l.t')} THEN p.stack ELSE {D.join('CASE WHEN len(m) = 0 THEN list_slice(s, 2, len(s)) ELSE s END')} END AS stack
  FROM part_lists l JOIN parted_python p USING (log_id))"""


def capital_parts(w: str) -> str:
    cut = f"string_split(regexp_replace({w}, '([A-Z][^A-Z]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda c: {D.subs('c', _TRIM)}), lambda c: c <> '')"


def _last_parts(w: str, n: int) -> str:
    parts = f"string_split({w}, '.')"
    return D.join(f"list_slice({parts}, greatest(len({parts}) - {n - 1}, 1), len({parts}))", ".")


def enriched_methods(t: str) -> str:
    """Outer boundaries are marked on both sides of whatever is no part of a name, so that neighbours share no mark."""
    names = f"list_filter({D.words('l', lower=False)}, lambda w: len(string_split(w, '.')) > 2 AND length(string_split(w, '.')[-1]) > 3)"
    placed = f"list_transform({names}, lambda w, i: {{'n': len(string_split(w, '.')), 'i': i, 'w': w}})"
    ordered = f"list_transform(list_sort({placed}), lambda o: o.w)"
    marked = r"regexp_replace(l, '([^\w.])', chr(1) || '\1' || chr(1), 'g')"
    full = f"'\\1' || w || ' ' || {_last_parts('w', 2)} || ' ' || {_last_parts('w', 1)} || ' ' || '\\2'"
    folded = f"list_reduce(list_concat([{marked}], {ordered}), lambda a, w: regexp_replace(a, '(^|' || chr(1) || ')' || w || '($|' || chr(1) || ')', {full}, 'g'))"
    return D.join(f"list_transform({D.lines(t)}, lambda l: replace({folded}, chr(1), ''))")


def enriched_exceptions(t: str) -> str:
    offered = f"flatten(list_transform(string_split({t}, ' '), lambda w: [w, {_last_parts('w', 2)}, {_last_parts('w', 1)}]))"
    return D.join(D.distinct(offered), " ")


def item_name_words(t: str) -> str:
    words = D.words(f"translate({t}, '-_', '  ')", lower=False, unique=False)
    last = "string_split(w, '.')[-1]"
    long_name = f"CASE WHEN len(string_split(w, '.')) > 2 AND length({last}) > 3 THEN [w, {_last_parts('w', 2)}, {_last_parts('w', 1)}] ELSE [w] END"
    return D.join(f"flatten(list_transform({words}, lambda w: CASE WHEN contains(w, '.') THEN list_concat({long_name}, {capital_parts(last)}) ELSE {capital_parts('w')} END))", " ")


def test_method_words(t: str) -> str:
    return D.join(f"flatten(list_transform({D.words(t, lower=False, unique=False)}, lambda w: CASE WHEN contains(w, '.') THEN [w] ELSE {capital_parts('w')} END))", " ")


def defect_tokens(t: str) -> str:
    def pairs(parts: str, least: int) -> str:
        two = f"list_transform(range(1, len({parts})), lambda i: lower({parts}[i] || {parts}[i + 1]))"
        return f"CASE WHEN len({parts}) > 2 THEN list_filter({two}, lambda x: length(x) > {least}) ELSE [] END"

    word = r"regexp_replace(r, '^\w\.', '')"
    flat = f"replace({word}, '_', '')"
    own = f"CASE WHEN length({flat}) >= 3 THEN [lower({flat})] ELSE [] END"
    capital = f"CASE WHEN contains({word}, '.') THEN [] ELSE {pairs(capital_parts(flat), 3)} END"
    under = pairs(f"string_split({word}, '_')", -1)
    return f"flatten(list_transform(regexp_extract_all({t}, '[\\w.]+'), lambda r: list_concat(list_concat({own}, {under}), {capital})))"


def generated_removed(t: str) -> str:
    """Between names, ``$`` becomes a dot if a dot or ``$`` comes before the one and ``.``, ``$``, ``(`` or ``@`` after the other."""
    before = D.subs(t, P.GENERATED_PARTS[:2])
    parts = f"string_split({before}, '$')"
    left = f"(regexp_matches({parts}[k], '\\.{_NAME}$') OR (k > 1 AND regexp_matches({parts}[k], '^{_NAME}$')))"
    right = f"(regexp_matches({parts}[k + 1], '^{_NAME}[.(@]') OR (k + 1 < len({parts}) AND regexp_matches({parts}[k + 1], '^{_NAME}$')))"
    inner = f"list_transform(range(1, len({parts}) + 1), lambda k: {parts}[k] || CASE WHEN k = len({parts}) THEN '' WHEN {left} AND {right} THEN '.' ELSE '$' END)"
    return D.subs(D.join(inner, ""), P.GENERATED_PARTS[3:])


def html_tags_removed(t: str) -> str:
    return D.subs(t, [(P.STYLE_TAG, " "), (P.SCRIPT_TAG, " "), (P.HTML_TAGS, " ")])


def html_cleaned(t: str) -> str:
    """A fold over the lines; each step's state has the place of the next line too."""
    none = "CAST([] AS VARCHAR[])"
    state = lambda line: f"{{'inside': false, 'done': {none}, 'part': {none}, 'line': {line}}}"
    inside = f"(a.inside OR regexp_matches(c.line, {D.lit(P.HTML_START)}))"
    ends = f"contains(c.line, '{P.HTML_END}')"
    part = f"CASE WHEN {inside} THEN list_append(a.part, c.line) ELSE a.part END"
    done = f"CASE WHEN {inside} THEN a.done ELSE list_append(a.done, c.line) END"
    cleaned = html_tags_removed(D.join(part))
    step = f"""{{'inside': {inside} AND NOT {ends}, 'done': CASE WHEN {ends} THEN list_append({done}, {cleaned}) ELSE {done} END,
  'part': CASE WHEN {ends} THEN {none} ELSE {part} END, 'line': ''}}"""
    folded = f"list_reduce(list_concat([{state(D.lit(''))}], list_transform({D.lines(t)}, lambda l: {state('l')})), lambda a, c: {step})"
    return D.no_empty_lines(D.join(f"list_transform([{folded}], lambda f: list_concat(f.done, f.part))[1]"))


def clustering_text(t: str, n_lines: int, codes: str | None = None) -> str:
    """``message_for_clustering``; with codes, numbers are cleaned and codes hidden and shown again by folds."""
    if codes is None:
        return _clustering_words(t, n_lines, D.subs(t, P.STARTING_DATETIME))
    marks = f"list_transform({codes}, lambda c, i: {{'t': c, 'm': '#&' || repeat('#', CAST(i AS BIGINT)) || '&#'}})"
    first = lambda text: f"list_concat([{{'t': {text}, 'm': ''}}], {marks})"
    hidden = f"list_reduce({first(D.subs(t, P.STARTING_DATETIME))}, lambda a, c: {{'t': regexp_replace(a.t, '\\b' || c.t || '\\b', c.m, 'g'), 'm': ''}}).t"
    shown = f"list_reduce({first(D.numbers_removed(hidden))}, lambda a, c: {{'t': replace(a.t, c.m, c.t), 'm': ''}}).t"
    return _clustering_words(t, n_lines, shown)


def _clustering_words(t: str, n_lines: int, plain: str) -> str:
    short = D.join(f"list_slice({D.lines(D.no_empty_lines(plain))}, 1, {n_lines})")
    words = D.words(short, 2, unique=False, lower=False)
    return f"CASE WHEN length({t}) > 0 THEN list_transform([{words}], lambda ws: CASE WHEN len(ws) = 1 THEN ws[1] || ' error' ELSE array_to_string(ws, ' ') END)[1] END"


def status_codes(t: str) -> str:
    groups = [f"regexp_extract(l, {D.lit(p.removeprefix('(?i)'))}, {g}, 'i')" for p, n in zip(P.STATUS_CODES, P.STATUS_GROUPS, strict=True) for g in range(1, n + 1)]
    return f"list_filter(flatten(list_transform({D.lines(t)}, lambda l: [{', '.join(groups)}])), lambda c: c <> '')"


def _trimmed_distinct(items: str) -> str:
    return D.distinct(f"list_filter({items}, lambda x: x <> '')")


def paths(t: str) -> str:
    return _trimmed_distinct(f"list_transform(regexp_extract_all({t}, {D.lit(P.PATH)}), lambda x: {D.subs('x', _TRIM)})")


def params(t: str) -> str:
    inner = "regexp_extract(q, " + D.lit("""[^'" ]*[^'"]+""") + ")"
    return _trimmed_distinct(f"list_transform(regexp_extract_all({t}, {D.lit(P.QUOTED)}, 1), lambda q: {D.subs(inner, _TRIM)})")


def urls(t: str) -> str:
    return f"regexp_extract_all({t}, {D.lit(P.URL.removeprefix('(?i)'))}, 0, 'i')"


def urls_decoded(t: str) -> str:
    return f"CASE WHEN url_decode({t}) <> {t} THEN {D.sub(f'url_decode({t})', '[(){}#%]', ' ')} ELSE {t} END"


def test_methods(t: str) -> str:
    found = D.distinct(f"list_concat(regexp_extract_all({t}, {D.lit(P.TEST_METHOD)}), regexp_extract_all({t}, {D.lit(P.TEST_FILE)}))")
    return f"list_filter({found}, lambda t: len({D.exceptions('t')}) = 0)"


def only_numbers(t: str) -> str:
    return D.join(D.words(D.sub(t, r"[^\d ._]"), unique=False), " ")


def unique_lines(t: str) -> str:
    kept = f"list_filter({D.lines(t)}, lambda l: NOT (contains(lower(l), 'documentation') AND contains(lower(l), 'error') AND contains(lower(l), 'visit')))"
    keys = f"list_transform({kept}, lambda l: {D.subs('l', _TRIM)})"
    return D.join(f"list_transform(list_filter(list_zip({kept}, {keys}, range(1, len({kept}) + 1)), lambda p: list_position({keys}, p[2]) = p[3]), lambda p: p[1])")


def basic_message(t: str) -> str:
    text = D.subs(t, _TRIM)
    for patterns in (P.STARTING_LEVEL, P.STARTING_DATETIME, P.STARTING_LEVEL, P.STARTING_THREAD_ID, P.STARTING_THREAD_NAME, P.STARTING_LEVEL):
        text = D.subs(text, patterns)
    return D.no_empty_lines(D.sub(D.sub(text, P.LINE_ENDING, "\n"), P.MARKDOWN_MARK))


def unified(source: str) -> str:
    """CTEs from ``source`` (log_id, t) to ``unified`` (log_id, t), a step each."""
    steps = [
        f"replace({D.subs(D.subs('t', P.CODE_SEPARATORS), P.WEBDRIVER)}, chr(9), chr(10))",
        urls_decoded("t"),
        generated_removed("t"),
        D.subs(D.subs(D.subs("t", P.UUIDS), P.ACCESS_TOKENS), P.HEX),
        html_cleaned("t"),
        D.no_empty_lines("t"),
        unique_lines("t"),
    ]
    names = [source, *(f"unified_{k}" for k in range(1, len(steps))), "unified"]
    return ",\n".join(f"{to} AS MATERIALIZED (SELECT log_id, {sql} AS t FROM {of})" for of, to, sql in zip(names, names[1:], steps, strict=False))


def prepared(clean: str, n_lines: int, for_clustering: bool) -> str:
    """CTEs from ``raw`` (log_id, t), ``basic`` and ``clean`` of the same columns to ``prepared``, a column per derived field."""
    first = lambda t: t if n_lines < 0 else D.join(f"list_slice({D.lines(t)}, 1, {n_lines})")
    ordered = "list_transform(list_sort(list_transform(methods, lambda w: {'n': -length(w), 'w': w})), lambda o: o.w)"
    short = lambda t: f"list_reduce(list_concat([{first(t)}], {ordered}), lambda a, w: replace(a, w, ' '))"
    no_specials = lambda t: D.sub(t, P.SPECIAL_CHARACTERS, " ")
    line = lambda f: f"replace({unique_lines(f)}, ':', ' : ') AS {f}"
    message = "short" if for_clustering else D.no_empty_lines(D.numbers_removed("short"))
    other = "original_message, potential_status_codes, message_params, message_lines, message_words_number, found_tests_and_methods, urls, paths"
    return f"""{parted(clean)},
field_1 AS MATERIALIZED (SELECT p.log_id, r.t AS original_message, b.t AS basic, p.t AS clean, p.message AS found, p.stack, {test_methods('p.t')} AS methods
  FROM parted p JOIN raw r USING (log_id) JOIN basic b USING (log_id)),
field_2 AS MATERIALIZED (SELECT *, {short('clean')} AS short, {short('basic')} AS message_for_clustering, {D.numbers_removed('found')} AS detected_message,
  {D.numbers_removed(D.sub('stack', P.BRACKETED))} AS stacktrace, {urls('found')} AS found_urls, {only_numbers('found')} AS only_numbers,
  {D.join(status_codes('found'), ' ')} AS potential_status_codes, {D.join(params('found'), ' ')} AS message_params, {count_lines('clean')} AS message_lines,
  CAST(len({D.words('clean', urls=False)}) AS INTEGER) AS message_words_number, {enriched_methods(D.join('methods', ' '))} AS found_tests_and_methods FROM field_1),
field_3 AS MATERIALIZED (SELECT *, found AS detected_message_with_numbers, {message} AS message, {D.subs(no_specials('detected_message'), P.SPACES)} AS detected_message_without_params_and_brackets,
  {D.join('found_urls', ' ')} AS urls, {D.join(paths(D.sub('found', P.URL, P.URL_TAG)), ' ')} AS paths, {D.join(D.exceptions('detected_message'), ' ')} AS found_exceptions FROM field_2),
field_4 AS MATERIALIZED (SELECT *, {no_specials('message')} AS message_without_params_and_brackets, {enriched_exceptions('found_exceptions')} AS found_exceptions_extended,
  {enriched_methods('found')} AS detected_message_extended, {enriched_methods('detected_message_without_params_and_brackets')} AS detected_message_without_params_extended,
  {enriched_methods('stacktrace')} AS stacktrace_extended, {enriched_methods('message')} AS message_extended FROM field_3),
field_5 AS MATERIALIZED (SELECT *, {enriched_methods('message_without_params_and_brackets')} AS message_without_params_extended FROM field_4),
field_6 AS MATERIALIZED (SELECT log_id, {other}, {', '.join(line(f) for f in LINE_FIELDS)} FROM field_5),
prepared AS (SELECT *, detected_message_without_params_and_brackets || chr(10) || stacktrace AS whole_message FROM field_6)"""


def prepared_sql(n_lines: int = -1, for_clustering: bool = False) -> str:
    clean = "basic" if for_clustering else "unified"
    texts = f"raw AS (SELECT log_id, message AS t FROM logs),\nbasic AS MATERIALIZED (SELECT log_id, {basic_message('t')} AS t FROM raw)"
    return f"{ORACLE_LOGS},\n{texts},\n{unified('basic')},\n{prepared(clean, n_lines, for_clustering)}\nSELECT * FROM prepared"


def unified_sql() -> str:
    return f"{ORACLE_LOGS},\nbasic AS MATERIALIZED (SELECT log_id, {basic_message('message')} AS t FROM logs),\n{unified('basic')}\nSELECT log_id, t AS value FROM unified"


def stack_words_sql() -> str:
    return f"""{ORACLE_LOGS}, errors AS (SELECT log_id, project, message AS t FROM logs WHERE log_level >= {P.ERROR_LEVEL} AND {D.filled('message')}),
{unified('errors')},
{parted('unified')},
found AS (SELECT e.project, unnest({D.words('p.stack')}) AS word FROM parted p JOIN errors e USING (log_id))
SELECT DISTINCT project, word FROM found WHERE len(string_split(word, '.')) > 2"""


def part_query(value: str, source: str = "parted") -> str:
    return f"{ORACLE_LOGS}, texts AS (SELECT log_id, message AS t FROM logs), {parted('texts')} SELECT log_id, {value} AS value FROM {source}"
