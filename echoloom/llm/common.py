"""Helpers shared by the text operators: shared-folder tables, table loading, vector hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b" \t\n\r\x0b\x0c"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may leave it unset (tests); it then gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what comes later neither recomputes df nor depends on
    shuffle files of executors that may be lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Deletes what settle wrote, once nothing that is still to come reads it."""
    for df in settled:
        _delete(df.sparkSession, df.settled_at)
        _written.remove((df.sparkSession, df.settled_at))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: More rows of one key than this are dealt to several tasks, and so many keys at most are listed as such.
HOT_ROWS = 1000
HOT_KEYS = 100_000


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """(keys, _n): keys that very many rows of df share, and the parts to deal their rows to; HOT_KEYS rows at most."""
    limit = max(HOT_ROWS, (df.count() if rows is None else rows) // HOT_KEYS)
    return df.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") > limit).select(*keys, F.ceil(F.col("_c") / limit).cast("int").alias("_n"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, vary: Column, how: str = "inner") -> DataFrame:
    """left joined to right (few rows for each key) on keys, null equal to null; the rows of keys in hot (hot_keys of left) go to
    several tasks by vary, and what right holds of such a key goes to each of them. how: inner, left or left_semi."""
    # hot has HOT_KEYS rows at most.
    known = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_n"))
    marked = lambda df: df.join(known, [df[k].eqNullSafe(known[f"_hot_{k}"]) for k in keys], "left").drop(*[f"_hot_{k}" for k in keys])
    parts = F.coalesce("_n", F.lit(1))
    one = marked(left.withColumn("_vary", vary)).withColumn("_part", F.pmod(F.col("_vary"), parts).cast("int")).drop("_vary", "_n")
    many = marked(right).withColumn("_to", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n")
    many = many.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [one[k].eqNullSafe(many[f"_right_{k}"]) for k in keys] + [one["_part"] == many["_to"]]
    return one.join(many, on, how).drop("_part", "_to", *[f"_right_{k}" for k in keys])


def text_hash(col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{col}`"), F.lit("")))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Rows of docs whose (id, hash of text and the columns in more) has kept = true in verdicts (id, _th, kept; a row for each of docs).

    The hash tells rows apart that share an id but not a text. Columns of docs may have any name.
    """
    th = text_hash(text_col)
    if more:
        th = F.xxhash64(th, *[F.col(f"`{c}`").cast("string") for c in more])
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("_k"), th.alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    said = verdicts.select(F.col(id_col).cast("long").alias("_k"), F.col("_th").alias("_h"), "kept")
    good = said.where("kept").select("_k", "_h").distinct()
    return spread_join(whole, good, ["_k", "_h"], hot_keys(said, ["_k", "_h"]), F.monotonically_increasing_id(), "left_semi").select("_row.*")


# ---------------------------------------------------------------- vector hashing

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 2 * len(_POWERS), 1 << 16)
        for base, name in ((_BASE, "_POWERS"), (_BASE_INVERSE, "_INVERSES")):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, from one pass of prefix sums."""
    _grow(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64) * _ODD)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]
