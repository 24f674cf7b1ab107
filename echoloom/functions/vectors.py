"""Functions on vectors (arrays of floats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """v at length 1; a zero vector stays zero (the length is 1e-12 at least)."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_pool_rows(tokens: DataFrame, by: list[str], vec: str, mask: str) -> DataFrame:
    """Mean of the token vectors whose mask is not 0, for each group; zeros where there is none (the count is 1e-9 at least)."""
    x = tokens.select(*by, F.posexplode(vec).alias("_k", "_x"), F.col(mask).alias("_m"))
    per = x.groupBy(*by, "_k").agg((F.sum(F.col("_x").cast("double") * F.when(F.col("_m") != 0, 1.0).otherwise(0.0)) / F.greatest(F.sum(F.when(F.col("_m") != 0, 1.0).otherwise(0.0)), F.lit(1e-9))).alias("_v"))
    return per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias(vec))


def mean_pool(tokens, mask):
    """The same for numpy arrays: tokens (n, t, d), mask (n, t)."""
    import numpy as np

    m = (mask != 0).astype(np.float64)[:, :, None]
    return (tokens * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def check_dim(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector is missing or of another width."""
    return df.where(F.coalesce(F.size(vec) != dim, F.lit(True)))


def truncation_report(df: DataFrame, n_tokens: str, cap: int, by: list[str] | None = None) -> DataFrame:
    """How many inputs reached the token cap."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col(n_tokens) >= cap).alias("n_capped"))


def cosine_agreement(a: DataFrame, b: DataFrame, on: str, vec: str) -> DataFrame:
    """(on, cosine) of the rows that both sides have."""
    x, y = a.select(on, F.col(vec).alias("_a")), b.select(on, F.col(vec).alias("_b"))
    n = F.greatest(norm(F.col("_a")) * norm(F.col("_b")), F.lit(1e-12))
    return x.join(y, on).select(on, (dot(F.col("_a"), F.col("_b")) / n).alias("cosine"))


# A gram's hash is taken modulo a prime, code point by code point, and stirred once at the end; in whole numbers below 2^63, so that any engine gives the same.
GRAM_PRIME, GRAM_BASE, GRAM_STIR = 2_147_483_647, 1_000_003, 48_271


def gram_counts(text: str, dim: int, n: int = 3, lowered: bool = False):
    """The counts of one text's n-grams, before they are brought to length 1, as a numpy array."""
    import numpy as np

    points = np.frombuffer((text if lowered else text.lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(points) < n:
        return np.zeros(dim)
    h = np.zeros(len(points) - n + 1, dtype=np.int64)
    for k in range(n):
        h = (h * GRAM_BASE + points[k : len(points) - n + 1 + k]) % GRAM_PRIME
    h = h * GRAM_STIR % GRAM_PRIME
    return np.bincount(h % dim, weights=np.where(h // dim % 2 == 0, 1.0, -1.0), minlength=dim)


def hashing_embed(df: DataFrame, id_col: str, col: str, dim: int = 256, n: int = 3) -> DataFrame:
    """(id, vector): counts of hashed character n-grams, signed, at length 1. Stands in for a model file.

    Texts are counted where they lie, some of a batch at a time, and only the counts, whole numbers, go on. Texts with fewer than n
    characters have a zero vector. Rows that repeat an id are one text's as far as counts go: they are added up.
    """
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            counts = np.zeros((b.num_rows, dim), dtype=np.int64)
            for k, t in enumerate(b.column(1)):
                counts[k] = gram_counts(t.as_py(), dim, n, lowered=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, dim), pa.int32()), pa.array(counts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "_c"])

    rows = df.select(F.col(id_col), F.lower(F.coalesce(F.col(col), F.lit(""))).alias("_t"))
    counted = rows.mapInArrow(run, StructType([rows.schema[id_col], StructField("_c", ArrayType(LongType()))]))
    sums = counted.groupBy(id_col).agg(F.array(*[F.sum(F.get("_c", F.lit(k))).cast("double") for k in range(dim)]).alias("_v"))
    return sums.select(id_col, l2_normalise(F.col("_v")).alias("vector"))
