"""Streaming forms of finished operators. Each works on a batch DataFrame as well, with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_of
from ..operators.pii import _spans, replace_spans
from ..operators.trends import labels_of
from ..operators.validate import screen_injection, validate_records

LATE = "10 minutes"


def window_alerts(stream: DataFrame, rules: DataFrame, length: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(metric, start, total, mean, rule): windows in which a rule holds. rules: a small table (metric, rule, stat sum|avg, op >|<, limit)."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "metric").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    m = w.join(F.broadcast(rules), "metric").withColumn("_v", F.when(F.col("stat") == "sum", F.col("total")).otherwise(F.col("mean")))
    hit = F.when(F.col("op") == ">", F.col("_v") > F.col("limit")).otherwise(F.col("_v") < F.col("limit"))
    return m.where(hit).select("metric", F.col("window.start").alias("start"), "total", "mean", "rule")


def stream_usage(calls: DataFrame, length: str = "1 hour", late: str = LATE) -> DataFrame:
    """Usage by tenant, operation and window. Percentiles are approximate, since exact ones have no bounded state."""
    ok = F.col("status") == "ok"
    out = calls.withWatermark("ts", late).groupBy(F.window("ts", length), "tenant_id", "operation").agg(
        F.count("*").alias("total"), F.count_if(~ok).alias("failed"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.percentile_approx(F.when(ok, F.col("call_duration_ms")), 0.95).alias("duration_p95")
    )
    return out.select(F.col("window.start").alias("start"), "tenant_id", "operation", "total", "failed", "cost_usd", "duration_p95")


def stream_invocations(calls: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Calls of one call_id, closed when none has come for the gap."""
    out = calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "tenant_id", "operation", "call_id").agg(F.count("*").alias("n_calls"), F.sum("call_duration_ms").alias("call_duration_ms"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))
    return out.select("tenant_id", "operation", "call_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_calls", "call_duration_ms", "cost_usd")


def stream_trends(records: DataFrame, fields: tuple[str, ...] = ("coding_level_1",), period: str = "week", ts: str | None = None, late: str = "1 day") -> DataFrame:
    """(code, period, count). With ts (a time column) a record that comes again within the watermark counts once."""
    if ts:
        records = records.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"]) if records.isStreaming else records.dropDuplicates(["id"])
    rows = records.select(period_of(F.col("created"), period).alias("period"), F.explode(labels_of(fields)).alias("code")).where("period is not null")
    return rows.groupBy("code", "period").agg(F.count("*").alias("count"))


def intake(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, redacted, and the quarantine with reasons; no state, so it serves each micro-batch.

    Placeholders number the types of a record's spans by place; the corpus-wide numbering of the batch operator would need state.
    """
    from ..operators.pii import DETECTORS

    good, bad = validate_records(records)
    screened = screen_injection(good)
    held = screened.where("injection is not null").withColumn("failed_rules", F.array("injection")).drop("injection")
    clean = screened.where("injection is null").drop("injection")
    found = F.concat(*[_spans(F.col("content"), t, p) for t, p in DETECTORS.items()])
    # As among spans of tables: those that no span overlaps which starts earlier, or at the same place and ends later; equal values of one type share a number.
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["type"].alias("type"), s["value"].alias("value"))))
    none = F.array().cast("array<struct<start:int,back:int,type:string,value:string>>")
    keep = lambda acc, s: F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(s))).otherwise(acc["out"])
    apart = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, s: F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), keep(acc, s).alias("out")), lambda acc: acc["out"])
    value = lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))
    clean = clean.withColumn("_s", apart).withColumn("_v", F.array_distinct(F.transform("_s", value)))
    number = lambda s: (F.array_position("_v", value(s)) - 1).cast("string")
    numbered = F.transform("_s", lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), F.concat(F.lit("<"), s["type"], F.lit("_"), number(s), F.lit(">")).alias("placeholder")))
    clean = clean.withColumn("_s", numbered).withColumn("content", replace_spans(F.col("content"), F.col("_s"))).drop("_s", "_v")
    return clean, bad.unionByName(held)


def stream_intake(records: DataFrame, good: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch's good and quarantined records to two sinks. The sinks get the batch number, to be idempotent."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        clean, bad = intake(batch)
        good(clean, n)
        quarantine(bad, n)
        batch.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
