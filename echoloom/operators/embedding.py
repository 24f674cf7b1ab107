"""Embedding with a pluggable model: texts in batches, one vector for each row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 100


@dataclass(frozen=True)
class Family:
    """What a family of models wants: a prefix to every text, how token vectors become one ('mean' or 'first'), a token cap."""

    prefix: str = ""
    pooling: str = "mean"
    max_tokens: int = 512


# Fixed values.
FAMILIES = {"e5": Family("query: ", "mean", 512), "bge": Family("", "first", 512), "plain": Family()}


def embed(df: DataFrame, col: str, make_model: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, family: Family = FAMILIES["plain"], batch: int = BATCH, out: str = "vector") -> DataFrame:
    """Adds out: the vector of each text, at length 1.

    make_model is called once in a Python worker and returns a function from texts to an array (n, dim), or to (tokens, mask)
    that is pooled here. Rows are handed over in batches of `batch`. A null text is embedded as ''.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        from ..functions.vectors import mean_pool

        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            got = model([str(t) for t in texts])
            if isinstance(got, tuple):
                tokens, mask = got
                got = mean_pool(tokens, mask) if family.pooling == "mean" else tokens[:, 0]
            got = np.asarray(got, dtype=np.float32)
            if got.shape != (len(texts), dim):
                raise ValueError(f"the model gave {got.shape}, not {(len(texts), dim)}")
            return got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)

        return predict

    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
    return df.withColumn(out, udf(F.concat(F.lit(family.prefix), F.coalesce(F.col(col), F.lit("")))))


def hashing_model(dim: int, n: int = 3) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model without files: hashed character n-grams, the vectors of hashing_embed."""

    def make():
        from ..functions.vectors import gram_counts

        return lambda texts: np.stack([gram_counts(t, dim, n) for t in texts])

    return make
