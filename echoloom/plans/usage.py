"""Queries over the log of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coerce_cost
from ..operators import usage as U
from ..operators import validate as V
from ..views import view, with_views

FROM, TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def _calls(spark, d) -> DataFrame:
    return view(spark, d, "calls")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _items(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["name"], x["total"].cast("string"), x["failed"].cast("string"), x["cost_usd"].cast("string"))), ",")
    return df.withColumn("items", text)


def h1_window(spark, d):
    return U.calls_in_window(_calls(spark, d), FROM, TO, "tenant_3").select("id", "tenant_id", "operation", F.col("ts").cast("string").alias("ts"), "cost_usd")


def h3_invocations(spark, d):
    return U.invocations(_calls(spark, d))


def h4_usage_cube(spark, d):
    return _rounded(U.usage_cube(U.calls_in_window(_calls(spark, d), FROM, TO)))


def h4_invocation_cube(spark, d):
    return _rounded(U.usage_cube(_calls(spark, d), "invocation"))


def h5_counts(spark, d):
    return U.usage_cube(_calls(spark, d), "invocation").select("grouping", "tenant_id", "operation", "total", "failed", "cost_usd")


def h6_distribution(spark, d):
    return _rounded(U.distributions(_calls(spark, d), ["model"], F.col("status") != "ok"))


def h7_zero_fill(spark, d):
    return _rounded(U.zero_fill(h6_distribution(spark, d)))


def h8_tenant(spark, d):
    return _rounded(U.usage_for_tenant(_calls(spark, d), "tenant_2", FROM, TO))


def h8_no_tenant(spark, d):
    return _rounded(U.usage_for_tenant(_calls(spark, d), "nobody", FROM, TO))


def h9_usage_by_tenant(spark, d):
    return _rounded(_items(U.usage_by_tenant(_calls(spark, d), FROM, TO)))


def h10_usage_by_operation(spark, d):
    return _rounded(_items(U.usage_by_operation(_calls(spark, d), view="invocation")))


def h11_breakdown(spark, d):
    return _items(U.breakdown(U.usage_cube(_calls(spark, d)), "operation"))


def h12_two_views(spark, d):
    return _rounded(U.two_views(_calls(spark, d)))


def h13_fan_out(spark, d):
    return _rounded(U.fan_out(_calls(spark, d)))


def h14_call_rows(spark, d):
    df = _calls(spark, d)
    c = F.struct(F.lit("x").alias("content"), F.col("model").alias("model"), F.col("input_tokens"), F.col("output_tokens"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("cost_usd").cast("double")).alias("cost"), F.col("status"), F.col("error_class"), F.col("call_duration_ms").alias("duration_ms"))
    return U.to_call_rows(df.select("tenant_id", "operation", "call_id", "ts", c.alias("completion"))).drop("ts")


def h15_priced(spark, d):
    out = U.price_calls(_calls(spark, d), view(spark, d, "prices"))
    return out.select("id", "model", F.round("priced_usd", 9).alias("priced_usd"), coerce_cost(F.col("priced_usd")).cast("decimal(12,6)").alias("cost_usd"))


def h16_backfilled(spark, d):
    df = _calls(spark, d).withColumn("call_id", F.when(F.col("id") % 3 > 0, F.col("call_id")))
    return U.backfill_call_id(df).select("id", "call_id")


def h17_trace(spark, d):
    return U.trace_call(_calls(spark, d), "call_7_1").select("id", "operation", F.col("ts").cast("string").alias("ts"), "call_duration_ms", "cost_usd", "status")


def h18_latency(spark, d):
    return U.latency_summary(_calls(spark, d), ["tenant_id"], "call_duration_ms")


def h19_merged(spark, d):
    a = _calls(spark, d).where("status = 'error'").select("id", "ts", F.col("error_class").alias("body"))
    b = view(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("text"), "user_id")
    return U.merge_logs(a, b, "body", "text").withColumn("ts", F.col("ts").cast("string"))


def h20_recent(spark, d):
    return U.recent_logs(_calls(spark, d), "2024-01-20 12:00:00", 240).select("id", F.col("ts").cast("string").alias("ts"), "operation")


def b7_call_rules(spark, d):
    df = _calls(spark, d)
    odd = df.withColumns({"status": F.when(F.col("id") % 97 == 0, "late").otherwise(F.col("status")), "call_duration_ms": F.when(F.col("id") % 89 == 0, -1).otherwise(F.col("call_duration_ms")), "error_class": F.when(F.col("id") % 83 == 0, "X").otherwise(F.col("error_class"))})
    return V.check_calls(odd).select("id", F.array_join("failed_rules", ",").alias("failed_rules"))


def _dist(col: str, p: str, cond: str, zero: bool) -> str:
    z = (lambda e: f"coalesce({e}, 0)") if zero else (lambda e: e)
    f = f"FILTER (WHERE {cond})"
    return ", ".join(
        [
            f"round({z(f'avg({col}) {f}')}, 6) AS {p}_avg",
            f"CAST({z(f'min({col}) {f}')} AS BIGINT) AS {p}_min",
            f"CAST({z(f'max({col}) {f}')} AS BIGINT) AS {p}_max",
            f"CAST({z(f'sum({col}) {f}')} AS BIGINT) AS {p}_total",
            f"round({z(f'quantile_cont({col}, 0.05) {f}')}, 6) AS {p}_p5",
            f"round({z(f'quantile_cont({col}, 0.95) {f}')}, 6) AS {p}_p95",
        ]
    )


def _cube(source: str, failed: str, group: str = "GROUP BY CUBE (tenant_id, operation)", head: str = "GROUPING(tenant_id, operation) AS grouping, tenant_id, operation,") -> str:
    return f"""SELECT {head} count(*) AS total, count(*) FILTER (WHERE {failed}) AS failed,
      CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18,6)) AS cost_usd, {', '.join(_dist(c, p, f'NOT ({failed})', True) for c, p in U.METRICS)} FROM {source} {group}"""


_INV = """inv AS (SELECT tenant_id, operation, call_id, CAST(sum(call_duration_ms) AS BIGINT) AS call_duration_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd, bool_and(status = 'error') AS all_failed, count(*) AS n_calls
  FROM calls GROUP BY ALL)"""
_WIN = f"win AS (SELECT * FROM calls WHERE ts >= '{FROM}' AND ts < '{TO}')"
_ITEM = "name || '/' || total || '/' || failed || '/' || cost_usd"


def _report(source: str, failed: str, axis: str, child: str, level: int) -> str:
    return f"""cube AS ({_cube(source, failed)}),
      nest AS (SELECT {axis} AS a, string_agg({child} || '/' || total || '/' || failed || '/' || cost_usd, ',' ORDER BY cost_usd DESC, {child}) AS items FROM cube WHERE grouping = 0 GROUP BY 1)
      SELECT cube.* EXCLUDE ({child}), nest.items FROM cube LEFT JOIN nest ON cube.{axis} = nest.a AND cube.grouping = {level} WHERE cube.grouping IN ({level}, 3)"""


_COLS = [f"{p}_{s}" for _, p in U.METRICS for s in U.STATS]
_TWO = "SELECT i.grouping, i.tenant_id, i.operation, " + ", ".join(f"i.{c} AS invocation_{c}" for c in ["total", "failed", "cost_usd", *_COLS]) + ", " + ", ".join(f"c.{c} AS call_{c}" for c in ["total", "failed", "cost_usd", *_COLS])
_TWO += " FROM i JOIN c ON i.grouping = c.grouping AND i.tenant_id IS NOT DISTINCT FROM c.tenant_id AND i.operation IS NOT DISTINCT FROM c.operation"
_BOTH = f"WITH {_INV}, i AS ({_cube('inv', 'all_failed')}), c AS ({_cube('calls', chr(39).join(['status = ', 'error', '']))})"

QUERIES = {
    k: f
    for k, f in globals().items()
    if k[0] in "hb" and k[1].isdigit() and callable(f)
}
SQL = {
    "h1_window": with_views(f"SELECT id, tenant_id, operation, CAST(ts AS VARCHAR) AS ts, cost_usd FROM calls WHERE ts >= '{FROM}' AND ts < '{TO}' AND tenant_id = 'tenant_3'", "calls"),
    "h3_invocations": with_views(f"WITH {_INV} SELECT * FROM inv", "calls"),
    "h4_usage_cube": with_views(f"WITH {_WIN} {_cube('win', chr(39).join(['status = ', 'error', '']))}", "calls"),
    "h4_invocation_cube": with_views(f"WITH {_INV} {_cube('inv', 'all_failed')}", "calls"),
    "h5_counts": with_views(f"WITH {_INV}, c AS ({_cube('inv', 'all_failed')}) SELECT grouping, tenant_id, operation, total, failed, cost_usd FROM c", "calls"),
    "h6_distribution": with_views("SELECT model, " + ", ".join(_dist(c, p, "status = 'ok'", False) for c, p in U.METRICS) + " FROM calls GROUP BY model", "calls"),
    "h7_zero_fill": with_views("SELECT model, " + ", ".join(_dist(c, p, "status = 'ok'", True) for c, p in U.METRICS) + " FROM calls GROUP BY model", "calls"),
    "h8_tenant": with_views(f"WITH {_WIN} " + _cube("win", "status = 'error'", "WHERE tenant_id = 'tenant_2'", "'tenant_2' AS tenant_id,"), "calls"),
    "h8_no_tenant": with_views(f"WITH {_WIN} " + _cube("win", "status = 'error'", "WHERE tenant_id = 'nobody'", "'nobody' AS tenant_id,"), "calls"),
    "h9_usage_by_tenant": with_views(f"WITH {_WIN}, " + _report("win", "status = 'error'", "tenant_id", "operation", 1), "calls"),
    "h10_usage_by_operation": with_views(f"WITH {_INV}, " + _report("inv", "all_failed", "operation", "tenant_id", 2), "calls"),
    "h11_breakdown": with_views(f"WITH cube AS ({_cube('calls', chr(39).join(['status = ', 'error', '']))}) SELECT operation, string_agg(tenant_id || '/' || total || '/' || failed || '/' || cost_usd, ',' ORDER BY cost_usd DESC, tenant_id) AS items FROM cube WHERE grouping = 0 GROUP BY 1", "calls"),
    "h12_two_views": with_views(f"{_BOTH} {_TWO}", "calls"),
    "h13_fan_out": with_views(f"{_BOTH} SELECT i.grouping, i.tenant_id, i.operation, i.total AS invocations, c.total AS calls, round(c.total / i.total, 6) AS fan_out FROM i JOIN c ON i.grouping = c.grouping AND i.tenant_id IS NOT DISTINCT FROM c.tenant_id AND i.operation IS NOT DISTINCT FROM c.operation", "calls"),
    "h14_call_rows": with_views("SELECT tenant_id, operation, call_id, call_duration_ms, model, input_tokens, output_tokens, CASE WHEN status = 'ok' AND id % 5 <> 0 THEN cost_usd ELSE CAST(0 AS DECIMAL(12,6)) END AS cost_usd, status, error_class FROM calls", "calls"),
    "h15_priced": with_views("WITH p AS (SELECT id, calls.model, coalesce(input_tokens * input_per_token + output_tokens * output_per_token, 0) AS c FROM calls LEFT JOIN prices ON calls.model = prices.model) SELECT id, model, round(c, 9) AS priced_usd, CAST(round(c, 6) AS DECIMAL(12,6)) AS cost_usd FROM p", "calls", "prices"),
    "h16_backfilled": with_views("SELECT id, CASE WHEN id % 3 > 0 THEN call_id ELSE 'filled-' || md5(CAST(id AS VARCHAR)) END AS call_id FROM calls", "calls"),
    "h17_trace": with_views("SELECT id, operation, CAST(ts AS VARCHAR) AS ts, call_duration_ms, cost_usd, status FROM calls WHERE call_id = 'call_7_1'", "calls"),
    "h18_latency": with_views("""WITH s AS (SELECT tenant_id, list_sort(list(call_duration_ms)) AS l, count(*) FILTER (WHERE status = 'ok') AS n_ok FROM calls GROUP BY 1)
      SELECT tenant_id, len(l) AS n, n_ok, l[1] AS min, l[-1] AS max, l[CAST(round_even(0.5 * (len(l) - 1), 0) AS INT) + 1] AS p50, l[CAST(round_even(0.95 * (len(l) - 1), 0) AS INT) + 1] AS p95, l[CAST(round_even(0.99 * (len(l) - 1), 0) AS INT) + 1] AS p99 FROM s""", "calls"),
    "h19_merged": with_views("SELECT id, CAST(ts AS VARCHAR) AS ts, NULL::BIGINT AS user_id, error_class AS message FROM calls WHERE status = 'error' UNION ALL SELECT event_id, CAST(ts AS VARCHAR), user_id, event_type FROM events", "calls"),
    "h20_recent": with_views("SELECT id, CAST(ts AS VARCHAR) AS ts, operation FROM calls WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 240 MINUTES AND ts <= TIMESTAMP '2024-01-20 12:00:00'", "calls"),
    "b7_call_rules": with_views("""WITH o AS (SELECT id, CASE WHEN id % 97 = 0 THEN 'late' ELSE status END AS status, CASE WHEN id % 89 = 0 THEN -1 ELSE call_duration_ms END AS dur, CASE WHEN id % 83 = 0 THEN 'X' ELSE error_class END AS e FROM calls)
      SELECT id, concat_ws(',', CASE WHEN dur < 0 THEN 'call_duration_ms' END, CASE WHEN status NOT IN ('ok', 'error') THEN 'status' END, CASE WHEN (e IS NOT NULL) <> (status = 'error') THEN 'error_class' END) AS failed_rules
      FROM o WHERE dur < 0 OR status NOT IN ('ok', 'error') OR (e IS NOT NULL) <> (status = 'error')""", "calls"),
}
