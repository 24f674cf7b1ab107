"""Numbers and running sums over the rows of a group in their order, with no task that holds a group: rows are dealt to ranges of
(group, order), counted and summed range by range, and what stands before a range is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled


def number_rows(df: DataFrame, by: list[str], order: list[str | Column], name: str = "rn", total: tuple[str, str] | None = None) -> DataFrame:
    """Adds name, from 0: the place of a row in its group by order (nulls first, as sorts have it). total = (column, new name) also adds the sum of a
    column over the rows up to this one, itself included.

    Rows that are equal in order get different numbers, in no stated order; a null in by is a group of its own. The rows are written to the
    shared folder once. The sums of ranges are numbered per group: a row for each range that holds some of the group.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.withColumns({f"_o{k}": c for k, c in enumerate(keys)})
    marks = [f"_o{k}" for k in range(len(keys))]
    ranged = ranged.repartitionByRange(*marks).sortWithinPartitions(*marks)
    # The partition stands in the upper bits of the id and the place in the lower ones; both are data once written.
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id()).drop(*marks))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    sums = {"_before": F.count("*"), "_first": F.min("_at")} | ({"_sum": F.sum(total[0])} if total else {})
    parts = ranged.groupBy("_range", *by).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums if c != "_first"]
    parts = parts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_first", *before)
    on = [ranged["_range"] == parts["_r"]] + [ranged[c].eqNullSafe(parts[f"_g{k}"]) for k, c in enumerate(by)]
    out = ranged.join(parts, on).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before")).cast("bigint"))
    if total:
        inside = F.sum(total[0]).over(W.partitionBy("_range", *by).orderBy("_at"))  # a range is of a task's size
        out = out.withColumn(total[1], F.col("_sum") + F.coalesce(inside, F.lit(0)))
    return out.select(*df.columns, name, *([total[1]] if total else []))
