"""Weighted choices from tables of weights: a draw meets the interval of the name it falls in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from the digest of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def weight_edges(weights: DataFrame, name: str, under: str | None = None, weight: str = "weight") -> DataFrame:
    """(under, name, lo, hi): for each name its part of [0, 1), in order of names, for each value of `under` on its own.

    A name that is repeated has the sum of its weights. Names, and values of `under`, that are null, and weights that are null, not finite or not above 0, have no part.
    """
    by = [under] if under else []
    kept = weights.where((F.col(weight) > 0) & (F.col(weight) < float("inf")) & ~F.isnan(F.col(weight).cast("double"))).dropna(subset=[name, *by])
    sums = kept.groupBy(*by, name).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    # A table of names is no table of records: those of one `under` are added up in a task.
    w = W.partitionBy(*by)
    upto = sums.withColumn("_hi", F.sum("_w").over(w.orderBy(name).rowsBetween(W.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("_hi").over(w.orderBy(name)), F.lit(0.0))
    total = F.max("_hi").over(w)
    return upto.select(*by, name, (before / total).alias("lo"), (F.col("_hi") / total).alias("hi"))


def choose(df: DataFrame, weights: DataFrame, name: str, seed: int | str, key: str = "id", under: str | None = None, weight: str = "weight", bins: int = BINS) -> DataFrame:
    """df with the column `name`: one of the names by weight, by a digest of seed and key; with `under`, one of those under the row's own value of that column.

    The draw and the intervals meet by their bin of [0, 1), an equi-join whose keys a common value of `under` shares with nothing: its rows
    are spread over the bins. Spark broadcasts the intervals where their size is known to be small, and shuffles otherwise. Each row stays once; it has null where nothing
    can be chosen. A column of that name is replaced. Rows with equal keys get equal names, a null key counts as empty.
    """
    by = [under] if under else []
    e = weight_edges(weights, name, under, weight)
    first, last = F.floor(F.col("lo") * bins), F.ceil(F.col("hi") * bins) - 1
    parts = e.select(*[F.col(c).alias("_under") for c in by], F.col(name).alias("_name"), "lo", "hi", F.explode(F.sequence(first, F.greatest(first, last))).alias("_bin")).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    drawn = df.drop(name).withColumn("_u", uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)).withColumn("_b", F.floor(F.col("_u") * bins))
    on = (F.col("_b") == F.col("_bin")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))
    if under:
        on = on & (drawn[under] == F.col("_under"))
    return drawn.join(parts, on, "left").select(*[c for c in df.columns if c != name], F.col("_name").alias(name))
