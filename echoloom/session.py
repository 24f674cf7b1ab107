"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import atexit

from pyspark.sql import SparkSession


def get_session(app: str = "echoloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution; further settings by name with _ for the dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without one gets a temporary folder."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else uses."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def checkpointed(df):
    """df, written to the shared folder and cut off from what made it; its partitions and the order inside them stay."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def settled(df, compression: str | None = None):
    """df as a table, written to the shared folder as Parquet and read back: cut off from what made it, and computed once where a reader takes only some columns.

    Cheaper than a checkpoint, which computes its last stage twice; but rows have no order, and partitions are others. Files go when the session's process ends.
    compression: of the files, where they hold texts (zstd); else the session's.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
