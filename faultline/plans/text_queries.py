"""One query per text rule, over the derived logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.functions import text as T
from faultline.plans import duck as D
from faultline.plans import text_oracles as O
from faultline.plans.logs import ORACLE_LOGS, logs

M = "message"
_HTML = [(P.STYLE_TAG, " "), (P.SCRIPT_TAG, " "), (P.HTML_TAGS, " ")]


def _j(items: str) -> str:
    return D.join(items, "|")


def _as_text(items: Column) -> Column:
    return F.array_join(items, "|")


#: Key -> (column of the message, DuckDB expression or None where the rule has a query of its own).
RULES: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "txt_01_replace_patterns": (lambda m: T.replaced(m, [("fail(ed)?", "FAIL$1"), (r"\s+", " ")]), D.subs(M, [("fail(ed)?", "FAIL$1"), (r"\s+", " ")])),
    "txt_02_starting_datetime": (T.remove_starting_datetime, D.subs(M, P.STARTING_DATETIME)),
    "txt_03_starting_level": (T.remove_starting_level, D.subs(M, P.STARTING_LEVEL)),
    "txt_04_starting_thread_id": (T.remove_starting_thread_id, D.subs(M, P.STARTING_THREAD_ID)),
    "txt_05_starting_thread_name": (T.remove_starting_thread_name, D.subs(M, P.STARTING_THREAD_NAME)),
    "txt_06_delete_empty_lines": (T.delete_empty_lines, D.no_empty_lines(M)),
    "txt_07_count_lines": (T.count_lines, f"CAST(len(list_filter({D.lines(M)}, lambda l: {D.filled('l')})) AS INTEGER)"),
    "txt_08_is_python_log": (T.is_python_log, f"list_distinct(regexp_extract_all({M} || ' ', '\\.({'|'.join(P.FILE_EXTENSIONS)})\\b[^.]', 1)) = ['py']"),
    "txt_09_is_message_start": (T.is_message_start, O.message_start(M)),
    "txt_10_remove_numbers": (T.remove_numbers, D.numbers_removed(M)),
    "txt_11_remove_bracketed": (T.remove_bracketed, D.sub(M, P.BRACKETED)),
    "txt_12_special_characters": (T.blank_special_characters, D.sub(M, P.SPECIAL_CHARACTERS, " ")),
    "txt_13_found_exceptions": (lambda m: _as_text(T.found_exceptions(m)), _j(D.exceptions(M))),
    "txt_14_status_codes": (lambda m: _as_text(T.status_codes(m)), _j(O.status_codes(M))),
    "txt_15_unique_status_codes": (lambda m: _as_text(T.unique_status_codes(m)), _j(D.distinct(O.status_codes(M)))),
    "txt_16_first_lines": (lambda m: T.first_lines(m, 2), D.join(f"list_slice({D.lines(M)}, 1, 2)")),
    "txt_17_split_words": (lambda m: _as_text(T.split_words(m)), _j(D.words(M))),
    "txt_18_split_words_kept": (lambda m: _as_text(T.split_words(m, 3, False, False, False)), _j(D.words(M, 3, False, False, False))),
    "txt_19_stack_lines": (lambda m: F.array_join(F.transform(T.lines_of(m), lambda x: T.is_stack_line(x).cast("string")), "|"), _j(f"list_transform({D.lines(M)}, lambda l: CAST({O.stack_line('l')} AS VARCHAR))")),
    "txt_20_message": (lambda m: T.split_message_and_stack(m)["message"], None),
    "txt_20_stack": (lambda m: T.split_message_and_stack(m)["stack"], None),
    "txt_21_python_parts": (lambda m: F.to_json(T.split_python_log(m)), None),
    "txt_22_unique_strings": (lambda m: _as_text(F.array_distinct(F.split(m, " "))), _j(D.distinct(f"string_split({M}, ' ')"))),
    "txt_23_clustering_text": (lambda m: T.message_for_clustering(m, 2, True), O.clustering_text(M, 2, D.distinct(O.status_codes(M)))),
    "txt_24_html_tags": (T.clean_html_tags, D.subs(M, _HTML)),
    "txt_26_decode_urls": (T.decode_urls, O.urls_decoded(M)),
    "txt_27_clean_html": (T.clean_html, O.html_cleaned(M)),
    "txt_28_only_numbers": (T.only_numbers, O.only_numbers(M)),
    "txt_29_enrich_methods": (T.enrich_methods, O.enriched_methods(M)),
    "txt_30_item_name_words": (T.test_item_name_words, O.item_name_words(M)),
    "txt_31_test_methods": (lambda m: _as_text(T.test_methods(m)), _j(O.test_methods(M))),
    "txt_32_test_method_words": (T.test_method_words, O.test_method_words(M)),
    "txt_33_defect_tokens": (lambda m: _as_text(T.defect_tokens(m)), _j(O.defect_tokens(M))),
    "txt_34_remove_uuids": (T.remove_uuids, D.subs(M, P.UUIDS)),
    "txt_35_remove_hex": (T.remove_hex, D.subs(M, P.HEX)),
    "txt_36_tabs_to_lines": (T.tabs_to_lines, f"replace({M}, chr(9), chr(10))"),
    "txt_37_line_endings": (T.unify_line_endings, D.sub(M, P.LINE_ENDING, "\n")),
    "txt_38_unify_spaces": (T.unify_spaces, D.subs(M, P.SPACES)),
    "txt_39_generated_parts": (T.remove_generated_parts, O.generated_removed(M)),
    "txt_40_unique_lines": (T.unique_lines, O.unique_lines(M)),
    "txt_41_space_colons": (T.space_colons, f"replace({M}, ':', ' : ')"),
    "txt_42_extract_urls": (lambda m: _as_text(T.extract_urls(m)), _j(O.urls(M))),
    "txt_43_extract_paths": (lambda m: _as_text(T.extract_paths(m)), _j(O.paths(M))),
    "txt_44_extract_params": (lambda m: _as_text(T.extract_params(m)), _j(O.params(M))),
    "txt_46_credentials": (lambda m: F.array_join(F.transform(T.extract_urls(m), T.remove_credentials), "|"), _j(f"list_transform(regexp_extract_all({M}, {D.lit(P.URL.removeprefix('(?i)'))}, 0, 'i'), lambda u: {D.sub('u', P.CREDENTIALS, '$1')})")),
    "txt_47_enrich_exceptions": (lambda m: T.enrich_exceptions(T.joined(T.found_exceptions(m), " ")), O.enriched_exceptions(D.join(D.exceptions(M), " "))),
    "txt_49_blank_pieces": (lambda m: T.blank_pieces(m, F.array(F.lit("failed"), F.lit("fail"), F.lit("at "))), f"replace(replace(replace({M}, 'failed', ' '), 'fail', ' '), 'at ', ' ')"),
    "txt_51_access_tokens": (T.remove_access_tokens, D.subs(M, P.ACCESS_TOKENS)),
    "txt_52_markdown": (T.remove_markdown_mark, D.sub(M, P.MARKDOWN_MARK)),
    "txt_53_code_separators": (T.replace_code_separators, D.subs(M, P.CODE_SEPARATORS)),
    "txt_54_webdriver": (T.remove_webdriver_info, D.subs(M, P.WEBDRIVER)),
    "txt_55_readable": (lambda m: T.readable(T.remove_numbers(m)), f"replace({D.numbers_removed(M)}, '{P.NUMBER_TAG}', '{P.READABLE_NUMBER}')"),
    "txt_56_remove_urls": (lambda m: T.remove_urls(m, T.extract_urls(m)), D.sub(M, P.URL, P.URL_TAG)),
    "txt_57_similarity_words": (lambda m: T.joined(T.similarity_words(m), " "), D.join(D.similarity_words(M), " ")),
    "txt_64_sorted_words": (lambda m: T.sorted_words(m), D.join(f"list_sort(list_filter(string_split_regex({M}, '\\s+'), lambda w: w <> ''))", " ")),
}


def _query(rule: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: logs(spark, sf_dir).select("log_id", rule(F.col("message")).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _query(rule) for key, (rule, _) in RULES.items()}


def oracles() -> dict[str, str]:
    plain = {key: f"{ORACLE_LOGS} SELECT log_id, {sql} AS value FROM logs" for key, (_, sql) in RULES.items() if sql is not None}
    as_json = "to_json({'message': message, 'stack': stack})"
    return plain | {"txt_20_message": O.part_query("message"), "txt_20_stack": O.part_query("stack"), "txt_21_python_parts": O.part_query(f"CAST({as_json} AS VARCHAR)", "parted_python")}
