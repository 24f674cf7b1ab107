"""Readers and writers. Every read has a schema; rows that do not fit it are kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_newlines
from ..schemas import CALL, METADATA_KEYS, PRICES, RAW_RECORD


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """id, content, metadata (a map, so that unknown keys can be seen) and, for JSON, _corrupt_record."""
    if fmt == "json":
        return spark.read.schema(RAW_RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema("id string, content string, metadata map<string,string>").format(fmt).load(path)


def read_yaml_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of YAML lists (id, content, metadata); a file is one task. A file that is no list gives a row with error alone."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in parts:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    items = yaml.safe_load(bytes(data))
                    if not isinstance(items, list):
                        raise ValueError("not a list")
                    rows = [(name, str(x.get("id")), str(x.get("content", "")), {k: str(v) for k, v in (x.get("metadata") or {}).items() if v is not None}, None) for x in items]
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    rows = [(name, None, None, {}, str(e)[:200])]
                yield pd.DataFrame(rows, columns=["file", "id", "content", "metadata", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, id string, content string, metadata map<string,string>, error string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_calls(df: DataFrame, path: str) -> None:
    """Append to the call log, which is partitioned by day."""
    df.withColumn("call_date", F.to_date("ts")).write.mode("append").partitionBy("call_date").parquet(path)


def read_calls(spark: SparkSession, path: str, tenant: str | None = None, from_=None, to=None) -> DataFrame:
    """The call log in a window; days outside it are not listed, times and tenants reach the scan."""
    df = spark.read.schema(f"{CALL}, call_date date").parquet(path)
    for bound, day, time in ((from_, lambda x: F.col("call_date") >= x, lambda x: F.col("ts") >= x), (to, lambda x: F.col("call_date") <= x, lambda x: F.col("ts") < x)):
        if bound is not None:
            df = df.where(day(F.to_date(F.lit(bound).cast("timestamp"))) & time(F.lit(bound).cast("timestamp")))
    return (df if tenant is None else df.where(F.col("tenant_id") == tenant)).drop("call_date")


#: What a node without an id is called, by level; below the third level, node.
LEVEL_NAMES = ("type", "category", "code")


def framework_nodes(books: DataFrame, name: str = "book", col: str = "value") -> DataFrame:
    """A row per node of codebooks, one JSON text each: name, node_id, parent_id, name of the node, level, position, description, examples, sensitive, feedback_type, error.

    A book has `types` with `categories` with `codes`, or `root_codes` with `children` of any depth; both are read level by level, all books at
    once, until no node has children. A node without an id is called after its place, as category-0-2. feedback_type is the name of
    the node's root. A text that is no JSON, or has neither list, is one row with error. A null text is no JSON; an empty list has no nodes.
    """
    node = "array<variant>"
    get = lambda c, key, kind: F.try_variant_get(F.col(c), f"$.{key}", kind)
    parsed = books.select(F.col(name).alias("book"), F.try_parse_json(F.col(col)).alias("v"))
    parsed = parsed.select("book", F.coalesce(get("v", "root_codes", node), get("v", "types", node)).alias("nodes"))
    blank = F.array().cast("array<int>")
    level = parsed.select("book", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("feedback_type"), blank.alias("places"), "nodes")
    out = parsed.where("nodes is null").select("book", F.lit("no codebook").alias("error"))
    depth = 0
    while True:
        kind = LEVEL_NAMES[depth] if depth < len(LEVEL_NAMES) else "node"
        rows = level.select("book", "parent_id", "feedback_type", "places", F.posexplode("nodes").alias("position", "v"))
        places = F.concat("places", F.array("position"))
        own = F.coalesce(get("v", "id", "string"), get("v", "code_id", "string"), F.concat(F.lit(f"{kind}-"), F.array_join(places.cast("array<string>"), "-")))
        rows = rows.select("book", "parent_id", places.alias("places"), "position", own.alias("node_id"), "feedback_type", "v")
        title = F.coalesce(get("v", "name", "string"), F.col("node_id"))
        rows = rows.select("book", "node_id", "parent_id", title.alias("name"), F.lit(depth + 1).alias("level"), "position", F.coalesce("feedback_type", title).alias("feedback_type"), "places",
            F.coalesce(get("v", "code_description", "string"), get("v", "description", "string"), F.lit("")).alias("description"),
            F.coalesce(get("v", "examples", "array<string>"), F.array().cast("array<string>")).alias("examples"), F.coalesce(get("v", "sensitive", "boolean"), F.lit(False)).alias("sensitive"),
            F.coalesce(*[get("v", k, node) for k in ("children", "categories", "codes")]).alias("nodes"))
        below = rows.where(F.size("nodes") > 0)
        out = out.unionByName(rows.drop("places", "nodes"), allowMissingColumns=True)
        if below.isEmpty():
            columns = ["node_id", "parent_id", "name", "level", "position", "description", "examples", "sensitive", "feedback_type", "error"]
            return out.select(F.col("book").alias(name), *columns)
        level = below.select("book", F.col("node_id").alias("parent_id"), "feedback_type", "places", "nodes")
        depth += 1


def read_framework(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the codebooks in JSON files of either shape, see framework_nodes; book is the file."""
    return framework_nodes(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book"), "value"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, input_per_token, output_per_token, max_tokens, error) of price lists, YAML (which JSON is too): `models` by name with costs per token, or lines of JSON with the columns.

    A file is one task. A model without both costs, a list that cannot be read and one without models are rows with error.
    """
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(PRICES).json(path)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in parts:
            rows = []
            for data in pdf["content"]:
                try:
                    models = (yaml.safe_load(bytes(data)) or {}).get("models") or {}
                    if not models:
                        rows.append((None, None, None, None, "no models"))
                    for model, x in models.items():
                        costs = [float(x[k]) if isinstance(x, dict) and x.get(k) is not None else None for k in ("input_cost_per_token", "output_cost_per_token")]
                        rows.append((str(model), *costs, x.get("max_tokens") if isinstance(x, dict) else None, "no cost" if None in costs else None))
                except Exception as e:  # noqa: BLE001  a bad list is a row
                    rows.append((None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["model", "input_per_token", "output_per_token", "max_tokens", "error"]).astype({"max_tokens": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, f"{PRICES}, max_tokens long, error string")


def build_payloads(insights: DataFrame, links: DataFrame, feedback: DataFrame, limit: int = 9999) -> DataFrame:
    """One JSON payload per insight: its linked feedback, the latest `limit` by created_at (ties by id), newlines cleaned, with all three levels of codes (a null level is left out)."""
    rows = insights.select("insight_id", "prompt").join(links, "insight_id").join(feedback, "feedback_id")
    w = W.partitionBy("insight_id").orderBy(F.desc("created_at"), "feedback_id")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    item = F.struct("_r", F.struct(F.col("feedback_id").cast("string").alias("id"), clean_newlines(F.col("text")).alias("content"), F.struct(F.col("created_at").cast("string").alias("created"), "coding_level_1", "coding_level_2", "coding_level_3").alias("metadata")).alias("x"))
    body = rows.groupBy("insight_id", "prompt").agg(F.transform(F.array_sort(F.collect_list(item)), lambda y: y["x"]).alias("feedback_records"))
    return body.select("insight_id", F.size("feedback_records").cast("bigint").alias("n"), F.to_json(F.struct(F.col("prompt"), "feedback_records")).alias("payload"))


def attach_pretty(insights: DataFrame, results: DataFrame) -> DataFrame:
    """insights with the pretty text of their JSON results; null where there is none."""
    text = results.select(F.col("insight_id").alias("_i"), F.get_json_object("response", "$.pretty_output").alias("pretty_output"))
    return insights.join(text, F.col("insight_id") == F.col("_i"), "left").drop("_i")


def metadata_struct(df: DataFrame, col: str = "metadata") -> DataFrame:
    return df.select("*", *[F.col(col)[k].alias(k) for k in METADATA_KEYS])
