"""Queries of log preparation, scalars and similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.functions import text as T
from faultline.operators import prepare, similarity
from faultline.plans import duck as D
from faultline.plans import text_oracles as O
from faultline.plans.logs import ORACLE_LOGS, events, logs

_ITEM = ["project", "launch_id", "launch_name", "issue_type", "unique_id", "test_case_hash", "test_item_name", "is_auto_analyzed"]


def pre_01_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("log_id", prepare.basic_message(F.col("message")).alias("value"))


def pre_03_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("log_id", prepare.unified_message(prepare.basic_message(F.col("message"))).alias("value"))


def pre_09_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_logs(logs(spark, sf_dir).select("log_id", "message"))


def pre_10_clustering_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_logs(logs(spark, sf_dir).select("log_id", "message"), 3, for_clustering=True)


def pre_12_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = prepare.select_logs(logs(spark, sf_dir))
    stored = prepare.prepare_logs(chosen.select("test_item_id", "log_id", "log_order", "log_level", "log_time", "message", *_ITEM))
    items = prepare.to_test_items(stored.withColumn("issue_type", T.lower_issue_prefix(F.col("issue_type"))), _ITEM)
    return items.select("test_item_id", *_ITEM, "log_count", F.to_json("logs").alias("logs"))


def pre_12_selected_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.select_logs(logs(spark, sf_dir), most=3).select("test_item_id", "log_id", "log_order")


def pre_13_stack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stack_words(logs(spark, sf_dir))


def last_unique_sql(text: str, where: str) -> str:
    """CTEs that end in ``chosen``: the logs of each item that stay when of like texts the last is kept."""
    return f"""{ORACLE_LOGS},
numbered AS (SELECT test_item_id AS grp, log_id, row_number() OVER (PARTITION BY test_item_id ORDER BY log_id) - 1 AS idx,
  list_filter(string_split_regex({text}, '\\W+'), lambda w: w <> '') AS ws FROM logs WHERE {where}),
terms AS (SELECT grp, idx, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM numbered),
tf AS (SELECT grp, idx, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT grp, count(*) AS n FROM numbered GROUP BY grp),
dfs AS (SELECT grp, term, count(*) AS df FROM tf GROUP BY ALL),
weighed AS (SELECT grp, idx, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (grp, term) JOIN sizes USING (grp)),
unit AS (SELECT grp, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, idx)) AS w FROM weighed),
near AS (SELECT a.grp, a.idx, b.idx AS j FROM unit a JOIN unit b ON a.grp = b.grp AND a.term = b.term AND a.idx < b.idx GROUP BY ALL HAVING round_even(sum(a.w * b.w), 6) >= 0.95),
last AS (SELECT n.grp, n.idx, coalesce(max(j), n.idx) AS last, max(s.n) AS n FROM numbered n JOIN sizes s USING (grp) LEFT JOIN near ON near.grp = n.grp AND near.idx = n.idx GROUP BY n.grp, n.idx),
folded AS (WITH RECURSIVE walk AS (
  SELECT grp, 0 AS i, n, [n - 1] AS kept FROM sizes
  UNION ALL
  SELECT w.grp, w.i + 1, w.n, CASE WHEN list_contains(w.kept, w.i) OR list_contains(w.kept, l.last) THEN w.kept ELSE list_append(w.kept, l.last) END
  FROM walk w JOIN last l ON l.grp = w.grp AND l.idx = w.i WHERE w.i < w.n - 1)
  SELECT grp, unnest(kept) AS idx FROM walk WHERE i = n - 1),
chosen AS (SELECT n.grp AS test_item_id, n.log_id, row_number() OVER (PARTITION BY n.grp ORDER BY n.idx DESC) AS back FROM numbered n JOIN folded f ON f.grp = n.grp AND f.idx = n.idx)
"""


_LAST_UNIQUE_CTE = last_unique_sql(D.join(D.similarity_words("message"), " "), "log_level >= 40000")


def num_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = logs(spark, sf_dir).withColumn("n", F.col("log_id") % 30)
    return row.select(
        "log_id",
        S.adaptive_threshold(F.col("n"), 0.95).alias("thr_95"),
        S.adaptive_threshold(F.col("n"), 0.8).alias("thr_80"),
        F.bround(S.log_weight(F.col("log_level"), F.col("n"), F.lit(29)), 6).alias("weight"),
        S.is_clustered_with_numbers(F.col("log_id")).alias("with_numbers"),
        S.text_hash(F.col("message")).alias("hash"),
        S.hash_bucket(F.col("unique_id")).alias("bucket"),
        S.synthetic_item_id(F.col("test_item_id"), F.col("n")).alias("synthetic"),
        F.bround(S.age_decay(F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.col("log_time").cast("timestamp_ntz"), 0.95), 6).alias("age"),
        F.bround(S.relevance_decay(F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("day", "log_time").cast("timestamp_ntz"), 0.5, 0.6), 6).alias("decay"),
    )


_NUM_SQL = f"""{ORACLE_LOGS}, t AS (SELECT *, log_id % 30 AS n FROM logs),
digits AS (SELECT log_id, sha1(message) AS h, md5(unique_id) AS b FROM logs)
SELECT log_id, CASE WHEN n > 0 AND (n - 1) / n >= 0.8 THEN least(0.95, round((n - 1) / n, 4)) ELSE 0.95 END AS thr_95,
  CASE WHEN n > 0 AND (n - 3) / n >= 0.8 THEN least(0.8, round((n - 3) / n, 4)) ELSE 0.8 END AS thr_80,
  round_even(log_level / 40000.0 * n / 29, 6) AS weight, log_id % 10 % 2 = 1 AS with_numbers,
  CAST(list_reduce(list_transform(range(1, 41), lambda i: CAST(instr('0123456789abcdef', substr(h, i, 1)) - 1 AS HUGEINT)), lambda a, c: (a * 16 + c) % 10000000000000000) AS BIGINT) AS hash,
  CAST(list_reduce(list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(b, i, 1)) - 1 AS HUGEINT)), lambda a, c: (a * 16 + c) % 100) AS BIGINT) AS bucket,
  -(test_item_id * 10 + n + 1) AS synthetic,
  round_even(exp(ln(0.95) * floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(log_time))) / 86400) / 7.0), 6) AS age,
  round_even(greatest(exp(ln(0.5) * greatest((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('day', log_time))) / 86400 - 1, 0) / 7.0), 0.6), 6) AS decay
FROM t JOIN digits USING (log_id)"""


def dat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    parts = F.array(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t).cast("int"), F.lit(3))
    rows = events(spark, sf_dir).select("event_id", parts.alias("parts"))
    rows = rows.withColumn("made", S.timestamp_of(F.col("parts")))
    text = F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", *[F.col("parts")[k] for k in range(6)])
    return rows.select("event_id", S.format_timestamp(F.col("made")).alias("formatted"), S.format_timestamp(S.normal_timestamp(text)).alias("normal"), S.normal_timestamp(F.lit("no time")).isNull().alias("none"))


def jsn_update_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"1": "ab001", "2": " ", "3": {"issueType": "pb00'), (F.col("event_id") % 10).cast("string"), F.lit('", "issueComment": "c"}}'))
    mapped = S.update_map(raw)
    return events(spark, sf_dir).select("event_id", F.explode(mapped).alias("id", "u")).select("event_id", "id", F.col("u.issueType").alias("issue_type"), F.col("u.issueComment").alias("comment"))


def arr_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("log_id", F.array_join(S.bigrams(T.split_words(F.col("message"))), "|").alias("value"))


def txt_48_feature_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("event_id") % 5
    text = F.concat(low.cast("string"), F.lit("-"), (low + 3).cast("string"), F.lit(", 12,,"))
    return events(spark, sf_dir).select("event_id", F.array_join(T.feature_range(text).cast("array<string>"), ",").alias("value"))


def txt_50_min_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", T.min_should_match((F.col("event_id") % 100) / 100.0).alias("value"))


def txt_58_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("issue_type")
    return logs(spark, sf_dir).select("log_id", T.lower_issue_prefix(i).alias("prefix"), T.normal_issue(i).alias("normal"), T.base_issue(i).alias("base"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log with the log 16 ids later: like texts with other numbers; one shuffle of the terms serves both sides."""
    texts = similarity.with_terms(logs(spark, sf_dir).select("log_id", "message"), "message", "t").repartition("log_id")
    return texts.alias("a").join(texts.alias("b"), F.expr("b.log_id = a.log_id + 16 + a.log_id % 3"))


def sim_02_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.similarity(F.col("a.t"), F.col("b.t"))
    return _neighbours(spark, sf_dir).select(F.col("a.log_id").alias("log_a"), F.col("b.log_id").alias("log_b"), s["similarity"].alias("similarity"), s["both_empty"].alias("both_empty"))


_SIM_SQL = f"""{ORACLE_LOGS},
w AS (SELECT log_id, message, {D.similarity_words('message')} AS ws FROM logs),
t AS (SELECT log_id, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS (SELECT log_id, term, count(*) AS n FROM t GROUP BY ALL),
norms AS (SELECT log_id, sum(n * n) AS norm FROM c GROUP BY log_id),
pairs AS (SELECT a.log_id AS a, b.log_id AS b, a.message AS am, b.message AS bm, array_to_string(a.ws, ' ') AS aw, array_to_string(b.ws, ' ') AS bw FROM w a JOIN w b ON b.log_id = a.log_id + 16 + a.log_id % 3),
dots AS (SELECT p.a, p.b, sum(x.n * y.n) AS dot FROM pairs p JOIN c x ON x.log_id = p.a JOIN c y ON y.log_id = p.b AND y.term = x.term GROUP BY ALL)
SELECT p.a AS log_a, p.b AS log_b, CASE WHEN aw = '' AND bw = '' THEN CASE WHEN trim(am) = '' AND trim(bm) = '' THEN 0.0 WHEN am = bm THEN 1.0 ELSE 0.0 END WHEN aw = '' OR bw = '' THEN 0.0 WHEN aw = bw THEN 1.0
  ELSE round_even(coalesce(dot, 0) / sqrt(CAST(na.norm AS DOUBLE) * nb.norm), 6) END AS similarity, aw = '' AND bw = '' AND trim(am) = '' AND trim(bm) = '' AS both_empty
FROM pairs p LEFT JOIN dots d ON d.a = p.a AND d.b = p.b LEFT JOIN norms na ON na.log_id = p.a LEFT JOIN norms nb ON nb.log_id = p.b"""


def sim_04_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = logs(spark, sf_dir).select("log_id", T.only_numbers(F.col("message")).alias("v"))
    both = numbers.alias("a").join(numbers.alias("b"), F.expr("b.log_id = a.log_id + 16"))
    return both.select(F.col("a.log_id").alias("log_id"), F.bround(similarity.value_overlap(F.col("a.v"), F.col("b.v")), 6).alias("value"))


_OVERLAP_SQL = f"""{ORACLE_LOGS}, v AS (SELECT log_id, {D.words(D.sub('message', r'[^\d ._]'), unique=False)} AS v FROM logs),
c AS (SELECT log_id, x, count(*) AS n FROM (SELECT log_id, unnest(v) AS x FROM v) GROUP BY ALL),
p AS (SELECT a.log_id, b.log_id AS other, len(a.v) AS na, len(b.v) AS nb FROM v a JOIN v b ON b.log_id = a.log_id + 16),
m AS (SELECT p.log_id, sum(least(x.n, y.n)) AS common FROM p JOIN c x ON x.log_id = p.log_id JOIN c y ON y.log_id = p.other AND y.x = x.x GROUP BY p.log_id)
SELECT p.log_id, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round_even(coalesce(common, 0) / greatest(na, nb) * (1 - (greatest(na, nb) - coalesce(common, 0)) / greatest(na, nb)), 6) END AS value FROM p LEFT JOIN m USING (log_id)"""


def sim_05_last_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.select_logs(logs(spark, sf_dir), most=0).select("test_item_id", "log_id")


def sim_06_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).where("log_level >= 40000").select(F.col("test_case_hash").alias("grp"), F.col("log_id").cast("int").alias("pos"), F.coalesce("issue_type", F.lit("")).alias("issue_type"), T.remove_numbers(F.col("message")).alias("text"))
    return similarity.dedupe_results(rows, ["text"]).select("grp", "pos")


_DEDUPE_SQL = f"""{ORACLE_LOGS},
w AS (SELECT *, {D.similarity_words('text')} AS ws FROM (SELECT test_case_hash AS grp, log_id AS pos, coalesce(issue_type, '') AS issue_type, {D.numbers_removed('message')} AS text FROM logs WHERE log_level >= 40000)),
t AS (SELECT pos, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS (SELECT pos, term, count(*) AS n FROM t GROUP BY ALL),
norms AS (SELECT pos, CAST(sum(n * n) AS DOUBLE) AS norm FROM c GROUP BY pos),
pairs AS (SELECT a.grp, a.pos AS i, b.pos AS j, trim(a.text) = '' AND trim(b.text) = '' OR a.text = b.text AS same, array_to_string(a.ws, ' ') AS aw, array_to_string(b.ws, ' ') AS bw
  FROM w a JOIN w b ON a.grp = b.grp AND a.issue_type = b.issue_type AND a.pos < b.pos),
dots AS (SELECT i, j, sum(x.n * y.n) AS dot FROM pairs JOIN c x ON x.pos = i JOIN c y ON y.pos = j AND y.term = x.term GROUP BY ALL),
twins AS (SELECT grp, j AS pos, list(i) AS twins FROM pairs LEFT JOIN dots USING (i, j) LEFT JOIN norms na ON na.pos = i LEFT JOIN norms nb ON nb.pos = j
  WHERE CASE WHEN aw = '' AND bw = '' THEN same WHEN aw = '' OR bw = '' THEN false WHEN aw = bw THEN true ELSE round_even(coalesce(dot, 0) / sqrt(na.norm * nb.norm), 6) >= 0.98 END GROUP BY ALL),
numbered AS (SELECT w.grp, w.pos, coalesce(twins, []) AS twins, row_number() OVER (PARTITION BY w.grp ORDER BY w.pos) AS k, count(*) OVER (PARTITION BY w.grp) AS n FROM w LEFT JOIN twins USING (grp, pos)),
folded AS (WITH RECURSIVE walk AS (SELECT grp, k, n, [pos] AS kept FROM numbered WHERE k = 1
  UNION ALL SELECT r.grp, x.k, r.n, CASE WHEN list_has_any(r.kept, x.twins) THEN r.kept ELSE list_append(r.kept, x.pos) END FROM walk r JOIN numbered x ON x.grp = r.grp AND x.k = r.k + 1)
  SELECT grp, unnest(kept) AS pos FROM walk WHERE k = n)
SELECT grp, CAST(pos AS INTEGER) AS pos FROM folded"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "pre_01_basic pre_03_unify pre_09_bundle pre_10_clustering_bundle pre_12_items pre_12_selected_logs pre_13_stack_words num_scalars dat_times jsn_update_map arr_bigrams txt_48_feature_range txt_50_min_should_match txt_58_issue_types sim_02_cosine sim_04_overlap sim_05_last_unique sim_06_dedupe"
    return {n: globals()[n] for n in names.split()}


def oracles() -> dict[str, str]:
    time = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"
    return {
        "pre_01_basic": f"{ORACLE_LOGS} SELECT log_id, {O.basic_message('message')} AS value FROM logs",
        "pre_03_unify": O.unified_sql(),
        "pre_09_bundle": O.prepared_sql(),
        "pre_10_clustering_bundle": O.prepared_sql(3, for_clustering=True),
        "pre_13_stack_words": O.stack_words_sql(),
        "pre_12_selected_logs": _LAST_UNIQUE_CTE + "SELECT test_item_id, log_id, row_number() OVER (PARTITION BY test_item_id ORDER BY back DESC) - 1 AS log_order FROM chosen WHERE back <= 3",
        "sim_05_last_unique": _LAST_UNIQUE_CTE + "SELECT test_item_id, log_id FROM chosen",
        "dat_times": f"SELECT event_id, {time} AS formatted, {time} AS normal, true AS none FROM events",
        "jsn_update_map": "SELECT event_id, u.id, u.t AS issue_type, u.c AS comment FROM (SELECT event_id, unnest([{'id': '1', 't': 'ab001', 'c': NULL}, {'id': '3', 't': 'pb00' || (event_id % 10), 'c': 'c'}]) AS u FROM events)",
        "arr_bigrams": f"{ORACLE_LOGS}, w AS (SELECT log_id, {D.words('message')} AS ws FROM logs) SELECT log_id, CASE WHEN len(ws) < 2 THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), '|') END AS value FROM w",
        "txt_48_feature_range": "SELECT event_id, array_to_string(list_append(range(event_id % 5, event_id % 5 + 4), 12), ',') AS value FROM events",
        "txt_50_min_should_match": "SELECT event_id, CAST(CAST(trunc((event_id % 100) / CAST(100 AS DOUBLE) * 100) AS INTEGER) AS STRING) || '%' AS value FROM events",
        "txt_58_issue_types": f"{ORACLE_LOGS} SELECT log_id, lower(substr(issue_type, 1, 2)) || substr(issue_type, 3) AS prefix, coalesce(lower(issue_type), '') AS normal, coalesce(CASE WHEN regexp_full_match(lower(issue_type), '[a-z]{{2}}\\d{{0,3}}') THEN substr(lower(issue_type), 1, 2) END, lower(issue_type), '') AS base FROM logs",
        "num_scalars": _NUM_SQL,
        "sim_06_dedupe": _DEDUPE_SQL,
        "sim_02_cosine": _SIM_SQL,
        "sim_04_overlap": _OVERLAP_SQL,
    }
