"""Log tables derived from ``events``: the same SQL text gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL, TAB, QUOTE, BACKSLASH = "chr(10)", "chr(9)", "chr(39)", "chr(92)"


def _text(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def _s(text: str) -> str:
    assert "'" not in text and "\\" not in text
    return f"'{text}'"


_ID, _N, _K = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)", "CAST(event_id % 7 AS STRING)"

#: One message for each remainder of the event id; they name what the text rules look for.
TEMPLATES = [
    _text(_s("2024-01-15 10:20:30,123 - ERROR [worker-"), _K, _s("] java.lang.IllegalStateException: Order "), _ID, _s(" of customer "), _N, _s(" failed with status code: 500"), NL, TAB, _s("at com.acme.shop.OrderService.place(OrderService.java:42)"), NL, TAB, _s("at com.acme.shop.Order$Item.check(Order.java:7)"), NL, TAB, _s("... 23 more")),
    _text(_s("ERROR Traceback (most recent call last):"), NL, _s("  File "), "chr(34)", _s("/app/tests/test_cart.py"), "chr(34)", _s(", line 12, in test_cart"), NL, _s("    cart.add("), _K, _s(")"), NL, _s("AssertionError: expected 5 but was "), _K),
    _text(_s("Cannot GET https://user:secret@shop.acme.org/api/v1/orders/"), _ID, _s("?x=1 response code 404 : file /var/log/app/out.log and C:"), BACKSLASH, _s("temp"), BACKSLASH, _s("out.txt missing")),
    _text(_s("Session 550e8400-e29b-41d4-a716-446655440000 lost at 0x00007f3a1b2c with id deadbeefdeadbeef12, com.acme.Session@1f2e3d closed")),
    _text(_s("{"), "chr(34)", _s("access_token"), "chr(34)", _s(": "), "chr(34)", _s("abc123"), "chr(34)", _s(", "), "chr(34)", _s("statusCode"), "chr(34)", _s(": "), "chr(34)", _s("401"), "chr(34)", _s("}"), NL, _s("Authorization: Bearer x.y.z"), NL, _s("AuthenticationFailure for user "), _N),
    _text(_s("[10:20:30] WARN acme.grid.NoSuchElementException: no such element"), NL, _s("Build info: version: "), QUOTE, _s("4.1.0"), QUOTE, _s(", revision: "), QUOTE, _s("87802e897b"), QUOTE, NL, _s("Driver info: acme.grid.RemoteDriver"), NL, _s("Screenshot: file:/tmp/build/"), _K, _s(".png"), NL, _s("Capabilities {browserName: chrome}"), NL, _s("Page source: file:/tmp/build/1.html")),
    _text(_s("!!!MARKDOWN_MODE!!! **Step**"), NL, _s("---"), NL, _s("code "), _K, NL, _s("==="), NL, _s("done ---")),
    _text(_s("Response was"), NL, _s("<html lang="), "chr(34)", _s("en"), "chr(34)", _s("><body><p>Error 503 &amp; more</p>"), NL, _s("<style>p</style></body></html>"), NL, _s("ServerError at end")),
    _text(_s("Value "), QUOTE, _s("abc "), _K, QUOTE, _s(" [x=1] {y} (z) of "), "chr(34)", _s("quoted"), "chr(34)", _s(" failed 12 times")),
    _text(_s("Acme.Shop.NullReferenceException: Object reference "), _ID, NL, _s("   at Acme.Shop.Cart.Add(Item item)"), NL, _s("   in Cart.cs:line 88"), NL, _s("   at Acme.Shop.Program.Main()")),
    _text(_s("12345 --- INFO GET https://acme.org/a%20b%28c%29 failed with code: 503 and order_status: 404")),
    _text(_s("com.acme.shop.CartTest.addsItem"), _K, _s(" failed in CheckoutSteps.paysByCard ui/login.spec.ts at step "), _ID),
    _text(_s("Retry failed"), NL, _s("Retry failed"), NL, _s("For documentation on this error please visit https://acme.org/err"), NL, _s("com.acme.net.TimeoutException after "), _ID, _s(" ms")),
    _text(_s("first  part "), TAB, _s(" "), "chr(13)", NL, _s(" second   part "), _K, NL, NL, _s("last")),
    _text(_s("(FATAL) java.lang.OutOfMemoryError: heap of "), _N, _s(" is full")),
    "'   '",
]

LOGS_SQL = f"""
SELECT event_id AS log_id, user_id * 100 + day(ts) AS test_item_id, day(ts) AS launch_id, user_id % 4 AS project,
  'nightly ' || CAST(user_id % 3 AS STRING) AS launch_name, 'auto:' || CAST(user_id AS STRING) AS unique_id, user_id AS test_case_hash,
  'checks-cart_itemNumber' || CAST(user_id % 9 AS STRING) || ' in com.acme.shop.CartTest' AS test_item_name,
  CASE WHEN event_id % 16 = 14 THEN 'PB001' WHEN event_id % 16 = 5 THEN 'ab001' WHEN user_id % 6 = 0 THEN 'AB001' WHEN user_id % 6 = 1 THEN 'pb001'
       WHEN user_id % 6 = 2 THEN 'si001' WHEN user_id % 6 = 3 THEN 'nd001' WHEN user_id % 6 = 4 THEN 'TI001' ELSE NULL END AS issue_type,
  event_id % 3 = 0 AS is_auto_analyzed, CASE event_type WHEN 'error' THEN 40000 WHEN 'purchase' THEN 40000 WHEN 'signup' THEN 50000 ELSE 20000 END AS log_level,
  ts AS log_time, value AS amount,
  CASE event_id % 16 {" ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEMPLATES))} END AS message
FROM events
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores is dealt out to all of them; larger tables are read as they lie."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log; the items and launches they belong to are columns."""
    events(spark, sf_dir).createOrReplaceTempView("faultline_events")
    return spark.sql(LOGS_SQL.replace("FROM events", "FROM faultline_events"))


#: The same rows for an oracle: ``WITH logs AS (...)``.
ORACLE_LOGS = f"WITH logs AS ({LOGS_SQL})"
