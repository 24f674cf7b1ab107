"""Usage and cost of model calls: windows, roll-ups, a two-axis cube with exact percentiles, nested reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled

METRICS = (("call_duration_ms", "duration"), ("input_tokens", "input"), ("output_tokens", "output"))
STATS = ("avg", "min", "max", "total", "p5", "p95")
MONEY = "decimal(18,6)"
BOTH, TENANT, OPERATION, TOTAL = 0, 1, 2, 3  # grouping ids of (tenant_id, operation)


def parse_window(from_: datetime, to: datetime) -> tuple[datetime, datetime]:
    """Both with a time zone, to after from_; in UTC."""
    for name, t in (("from", from_), ("to", to)):
        if t.tzinfo is None or t.utcoffset() is None:
            raise ValueError(f"'{name}' needs a time zone")
    if to <= from_:
        raise ValueError("'to' must be later than 'from'")
    return from_.astimezone(UTC), to.astimezone(UTC)


def calls_in_window(df: DataFrame, from_=None, to=None, tenant: str | None = None) -> DataFrame:
    """Calls with from_ <= ts < to, of one tenant if given. Plain comparisons, so they reach the scan."""
    kind = dict(df.dtypes)["ts"]
    if from_ is not None:
        df = df.where(F.col("ts") >= F.lit(from_).cast(kind))
    if to is not None:
        df = df.where(F.col("ts") < F.lit(to).cast(kind))
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def invocations(df: DataFrame) -> DataFrame:
    """Calls summed by (tenant_id, operation, call_id); an invocation has failed when all its calls have."""
    return df.groupBy("tenant_id", "operation", "call_id").agg(
        F.sum("call_duration_ms").alias("call_duration_ms"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").cast(MONEY).alias("cost_usd"),
        F.bool_and(F.col("status") == "error").alias("all_failed"),
        F.count("*").alias("n_calls"),
    )


def _value_counts(rows: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """(by, _m, _v, _c, _total, _failed, _cost): counts of each value of a metric over rows that did not fail, and under metric '' the totals of all."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    piece = lambda m, v, total, bad, cost: F.struct(F.lit(m).alias("_m"), v.alias("_v"), total.alias("_total"), bad.alias("_failed"), cost.cast(MONEY).alias("_cost"))
    pieces = [piece("", none, F.lit(1).cast("bigint"), failed.cast("bigint"), F.col("cost_usd"))]
    pieces += [piece(p, F.when(~failed, F.col(col)).cast("bigint"), zero, zero, F.lit(0)) for col, p in METRICS]
    long = rows.select(*by, F.explode(F.array(*pieces)).alias("_x")).select(*by, "_x.*").where("_m = '' or _v is not null")
    return long.groupBy(*by, "_m", "_v").agg(F.count("_v").alias("_c"), F.sum("_total").alias("_total"), F.sum("_failed").alias("_failed"), F.sum("_cost").alias("_cost"))


def _bin(v: Column) -> Column:
    """Bins in the order of values, each a 256th of its power of two wide; 2^15 of them for all 64-bit integers."""
    size = F.when(v < -(2**63 - 1), F.lit(2**63 - 1)).otherwise(F.abs(v))
    up = F.greatest(F.length(F.bin(size)) - 9, F.lit(0))  # bits that a bin leaves open
    place = up * 512 + F.call_function("shiftright", size, up)
    return F.when(v < 0, -1 - place).otherwise(place)


def _distributions(counts: DataFrame, by: list[str], place: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(by, total, failed, cost_usd, avg, min, max, total, p5 and p95 of each metric) from value counts; place says to which cells a row belongs.

    Percentiles are exact and interpolated. Values are counted by bin; a rank lies in the bin where the counts of bins reach it, and only inside
    bins are values sorted, so that no task sorts a cell. What is summed over the bins of a cell are 2^15 rows at most.
    """
    ranks = {f"{name}_{end}": (q, f) for name, q in (("p5", 0.05), ("p95", 0.95)) for end, f in (("lo", F.floor), ("hi", F.ceil))}  # from 0, may lie between two rows
    own = [*by, "_m", "_bin"]
    binned = place(settled(counts)).withColumn("_bin", _bin(F.col("_v")))  # read twice: counts and sums by bin, then the bins that hold a rank
    sums = {"_n": "_c", "_total": "_total", "_failed": "_failed", "_cost": "_cost"}
    bins = binned.groupBy(*own).agg(F.sum(F.col("_v") * F.col("_c")).alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *[F.sum(c).alias(k) for k, c in sums.items()])
    cell = W.partitionBy(*by, "_m")
    upto = F.coalesce(F.sum("_n").over(cell.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"_before": upto, "_all": F.sum("_n").over(cell)})
    inside = {}  # the rank inside the bin that holds it
    for k, (q, f) in ranks.items():
        r = f(F.lit(q) * (F.col("_all") - 1)) - F.col("_before")
        inside[k] = F.when((r >= 0) & (r < F.col("_n")), r)
    holds = F.collect_list(F.when(F.coalesce(*inside.values()).isNotNull(), F.struct("_bin", *[c.alias(k) for k, c in inside.items()])))
    figures = {"_n": F.max("_all"), "sum": F.sum("_sum"), "min": F.min("_min"), "max": F.max("_max")} | {c: F.sum(c) for c in ("_total", "_failed", "_cost")}
    cells = bins.groupBy(*by, "_m").agg(*[c.alias(k) for k, c in figures.items()], holds.alias("_holds"))
    cells = cells.select("*", F.explode_outer("_holds").alias("_h")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_m"])], *figures, "_h.*").withColumnRenamed("_bin", f"_k{len(by) + 1}")
    keys = [f"_k{i}" for i in range(len(own))]
    # Counts of values are small as written, but not as the rows of four cells each that a broadcast would make of them.
    met = cells.join(binned.select(*own, "_v", "_c").hint("merge"), [F.col(c).eqNullSafe(F.col(k)) for k, c in zip(keys, own, strict=True)], "left")
    met = met.withColumn("_in", F.sum("_c").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    found = [F.min(F.when(F.col("_in") > F.col(k), F.col("_v"))).alias(k) for k in ranks]
    one = met.groupBy(*keys[:-1]).agg(*[F.first(k).alias(k) for k in figures], *found).withColumnsRenamed(dict(zip(keys[:-1], [*by, "_m"], strict=True)))

    def between(name: str, q: float) -> Column:
        at, lo, hi = F.lit(q) * (F.col("_n") - 1), F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(lo == hi, lo.cast("double")).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name)

    stats = F.struct((F.col("sum").cast("double") / F.col("_n")).alias("avg"), "min", "max", F.col("sum").alias("total"), between("p5", 0.05), between("p95", 0.95))
    one = one.select(*by, "_m", "_total", "_failed", "_cost", F.when(F.col("_m") != "", stats).alias("_s"))
    out = one.groupBy(*by).agg(F.sum("_total").alias("total"), F.sum("_failed").alias("failed"), F.coalesce(F.sum("_cost"), F.lit(0)).cast(MONEY).alias("cost_usd"), *[F.max(F.when(F.col("_m") == p, F.col("_s"))).alias(f"_{p}") for _, p in METRICS])
    return out.select(*by, "total", "failed", "cost_usd", *[F.col(f"_{p}")[x].alias(f"{p}_{x}") for _, p in METRICS for x in STATS])


def distributions(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """avg, min, max, total and the interpolated 5th and 95th percentile of the metrics of each group, over rows that did not fail; null without any."""
    return _distributions(_value_counts(df, by, F.coalesce(failed, F.lit(False))), by).drop("total", "failed", "cost_usd")


def zero_fill(df: DataFrame) -> DataFrame:
    """Distributions of no row are zeros, not nulls."""
    kinds = dict(df.dtypes)
    fill = {f"{p}_{s}": F.coalesce(f"{p}_{s}", F.lit(0).cast(kinds[f"{p}_{s}"])) for _, p in METRICS for s in STATS if f"{p}_{s}" in kinds}
    return df.withColumns(fill)


def _cubes(df: DataFrame, *views: str) -> DataFrame:
    """Cells of one or both views, all from one table of value counts: _view, tenant_id, operation, grouping and figures."""
    rows = None
    for v in views:
        one = invocations(df) if v == "invocation" else df
        failed = F.col("all_failed") if v == "invocation" else F.col("status") == "error"
        one = one.select(F.lit(v).alias("_view"), "tenant_id", "operation", *[F.col(c).cast("bigint").alias(c) for c, _ in METRICS], F.col("cost_usd").cast(MONEY).alias("cost_usd"), F.coalesce(failed, F.lit(False)).alias("_bad"))
        rows = one if rows is None else rows.unionByName(one)
    counts = _value_counts(rows, ["_view", "tenant_id", "operation"], F.col("_bad"))
    cell = lambda g, t, o: F.struct(F.lit(g).cast("bigint").alias("grouping"), (F.col("tenant_id") if t else F.lit(None).cast("string")).alias("tenant_id"), (F.col("operation") if o else F.lit(None).cast("string")).alias("operation"))
    cells = F.array(cell(BOTH, True, True), cell(TENANT, True, False), cell(OPERATION, False, True), cell(TOTAL, False, False))
    by = ["_view", "grouping", "tenant_id", "operation"]

    def place(base: DataFrame) -> DataFrame:
        placed = base.select("_view", F.explode(cells).alias("_x"), "_m", "_v", "_c", "_total", "_failed", "_cost").select("_view", "_x.*", "_m", "_v", "_c", "_total", "_failed", "_cost")
        kinds = dict(placed.dtypes)
        nothing = {"_view": F.explode(F.array(*map(F.lit, views))), "grouping": F.lit(TOTAL), "_m": F.lit(""), "tenant_id": F.lit(None), "operation": F.lit(None), "_v": F.lit(None)}
        empty = df.sparkSession.range(1).select(*[(nothing[c] if c == "_view" else nothing.get(c, F.lit(0)).cast(kinds[c])).alias(c) for c in placed.columns])
        return placed.unionByName(empty)

    out = _distributions(counts, by, place)
    return zero_fill(out.select("_view", "tenant_id", "operation", "grouping", *[c for c in out.columns if c not in by]))


def usage_cube(df: DataFrame, view: str = "call") -> DataFrame:
    """One pass over four grouping sets: (tenant, operation), (tenant), (operation), ().

    view 'call' counts calls, 'invocation' the sums of invocations. Totals and costs are over all rows, distributions
    over rows that did not fail. grouping tells a roll-up's null from a null in the data. The grand total is there
    even without input. Rows shrink to counts of values by (tenant, operation) before they are rolled up.
    """
    return _cubes(df, view).drop("_view")


def usage_for_tenant(df: DataFrame, tenant: str, from_=None, to=None, view: str = "call") -> DataFrame:
    """One row: the tenant's usage; zeros when it has no call."""
    cells = usage_cube(calls_in_window(df, from_, to, tenant), view).where(F.col("grouping") == TOTAL)
    return cells.select(F.lit(tenant).alias("tenant_id"), *[c for c in cells.columns if c not in ("tenant_id", "operation", "grouping")])


def breakdown(cells: DataFrame, axis: str) -> DataFrame:
    """Children of each member of an axis (tenant_id or operation), nested: highest cost first, then by name."""
    child = "operation" if axis == "tenant_id" else "tenant_id"
    item = F.struct((-F.col("cost_usd")).alias("k"), F.col(child).alias("name"), "total", "failed", "cost_usd")
    nested = cells.where((F.col("grouping") == BOTH) & (F.col("total") > 0)).groupBy(axis).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return nested.select(axis, F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["total"].alias("total"), x["failed"].alias("failed"), x["cost_usd"].alias("cost_usd"))).alias("items"))


def _report(cells: DataFrame, axis: str, level: int) -> DataFrame:
    """Rows of an axis and the grand total, with the children of each as items (null for the grand total); cells are read once."""
    child = "operation" if axis == "tenant_id" else "tenant_id"
    own = F.col("grouping") != BOTH
    item = F.struct((-F.col("cost_usd")).alias("k"), F.col(child).alias("name"), "total", "failed", "cost_usd")
    rows = cells.where(F.col("grouping").isin(BOTH, level, TOTAL))
    groups = rows.groupBy(F.when(own, F.col("grouping")).otherwise(level).alias("_level"), F.col(axis).alias("_axis"))
    nested = groups.agg(F.first(F.when(own, F.struct(*cells.columns)), ignorenulls=True).alias("_own"), F.array_sort(F.collect_list(F.when(~own & (F.col("total") > 0), item))).alias("_l"))
    plain = F.transform("_l", lambda x: F.struct(x["name"].alias("name"), x["total"].alias("total"), x["failed"].alias("failed"), x["cost_usd"].alias("cost_usd")))
    return nested.select("_own.*", F.when(F.size("_l") > 0, plain).alias("items"))


def usage_by_tenant(df: DataFrame, from_=None, to=None, view: str = "call") -> DataFrame:
    """Tenants by name, then the grand total, which is always there; operations nested."""
    cells = usage_cube(calls_in_window(df, from_, to), view)
    return _report(cells, "tenant_id", TENANT).drop("operation").orderBy("grouping", "tenant_id")


def usage_by_operation(df: DataFrame, from_=None, to=None, view: str = "call") -> DataFrame:
    """Operations by cost, highest first, ties by name, then the grand total; tenants nested."""
    cells = usage_cube(calls_in_window(df, from_, to), view)
    return _report(cells, "operation", OPERATION).drop("tenant_id").orderBy("grouping", F.desc("cost_usd"), "operation")


def two_views(df: DataFrame) -> DataFrame:
    """Per-invocation and per-call figures of every cell side by side, from one table of value counts."""
    key = ["grouping", "tenant_id", "operation"]
    cells = _cubes(df, "invocation", "call")
    own = [c for c in cells.columns if c not in (*key, "_view")]
    sides = cells.groupBy(*key).agg(*[F.first(F.when(F.col("_view") == v, F.struct(*own)), ignorenulls=True).alias(f"_{v}") for v in ("invocation", "call")])
    return sides.select(*key, *[F.col(f"_{v}")[c].alias(f"{v}_{c}") for v in ("invocation", "call") for c in own])


def fan_out(df: DataFrame) -> DataFrame:
    """Calls per invocation of every cell."""
    both = two_views(df)
    return both.select("grouping", "tenant_id", "operation", F.col("invocation_total").alias("invocations"), F.col("call_total").alias("calls"), F.try_divide("call_total", "invocation_total").alias("fan_out"))


def to_call_rows(results: DataFrame, completion: str = "completion") -> DataFrame:
    """Log rows from completions: tokens and cost of good ones, zeros and the error class of the others."""
    c = F.col(completion)
    ok = c["status"] == "ok"
    zero = F.lit(0).cast("bigint")
    from ..functions.text import coerce_cost

    return results.select(
        "tenant_id",
        "operation",
        "call_id",
        "ts",
        F.coalesce(c["duration_ms"], zero).alias("call_duration_ms"),
        F.when(ok, F.coalesce(c["model"], F.lit(""))).otherwise(F.lit("")).alias("model"),
        F.when(ok, F.coalesce(c["input_tokens"], zero)).otherwise(zero).alias("input_tokens"),
        F.when(ok, F.coalesce(c["output_tokens"], zero)).otherwise(zero).alias("output_tokens"),
        F.when(ok, coerce_cost(c["cost"])).otherwise(F.lit(0).cast("decimal(12,6)")).alias("cost_usd"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(~ok, F.coalesce(c["error_class"], F.lit("LLMError"))).alias("error_class"),
    )


def price_calls(df: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd from tokens and prices; an unknown model costs 0."""
    p = prices.select(F.col("model").alias("_m"), "input_per_token", "output_per_token")
    joined = df.join(p, F.col("model") == F.col("_m"), "left")
    cost = F.col("input_tokens") * F.col("input_per_token") + F.col("output_tokens") * F.col("output_per_token")
    return joined.withColumn("priced_usd", F.coalesce(cost, F.lit(0.0))).drop("_m", "input_per_token", "output_per_token")


def backfill_call_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Calls without a call_id get one of their own, from a digest of their key: a task that runs again gives the same."""
    return df.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("filled-"), F.md5(F.col(key).cast("string").cast("binary")))))


def trace_call(df: DataFrame, call_id: str) -> DataFrame:
    return df.where(F.col("call_id") == call_id).orderBy("ts", "id")


def latency_summary(df: DataFrame, by: list[str], value: str, status: str = "status") -> DataFrame:
    """Counts, min, max and nearest-rank p50, p95, p99 (rank round(p (n - 1)), half to even) for each group.

    Ranks come from a count per value, not from a sorted list of all rows.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"), F.count_if(F.col(status) == "ok").alias("_ok"))
    w = W.partitionBy(*by).orderBy(value)
    s = counts.where(F.col(value).isNotNull()).withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    rank = lambda p: F.bround(F.lit(p) * (F.col("_n") - 1), 0).cast("bigint") + 1
    s = s.withColumns({f"_p{int(p * 100)}": F.when(F.col("_upto") >= rank(p), F.col(value)) for p in (0.5, 0.95, 0.99)})
    return s.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum("_ok").alias("n_ok"), F.min(value).alias("min"), F.max(value).alias("max"), *[F.min(f"_p{p}").alias(f"p{p}") for p in (50, 95, 99)])


def merge_logs(a: DataFrame, b: DataFrame, message_a: str, message_b: str) -> DataFrame:
    """Two logs with different message columns as one, newest first."""
    one = a.unionByName(b, allowMissingColumns=True)
    return one.withColumn("message", F.coalesce(message_a, message_b)).drop(message_a, message_b).orderBy(F.desc("ts"), "id")


def recent_logs(df: DataFrame, now, minutes: int) -> DataFrame:
    """Rows of the last minutes before now, newest first."""
    end = F.lit(now).cast(dict(df.dtypes)["ts"])
    return df.where((F.col("ts") > end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= end)).orderBy(F.desc("ts"))
