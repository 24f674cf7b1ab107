"""Validation and screening of records, requests and log rows. A row that breaks a rule goes to a quarantine with the
names of the rules it broke; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import DEPRECATED_KEYS, MAX_CONTENT, METADATA_KEYS, OPERATIONS, STATUSES

NO_CONTENT = "No content to analyse: every record was empty."
NO_SENSITIVE_CONTENT = "No content to screen."
DISCLAIMER = "Note: written by a machine; a person should check it. Marks such as <PERSON_0> stand for names that were taken out on purpose.\n\n"


def failed_rules(**rules: Column) -> Column:
    """Names of the rules whose condition (true = broken) holds; null counts as not broken."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def split_by_rules(df: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with failed_rules. Both are lazy filters over the same plan."""
    named = df.withColumn("failed_rules", failed_rules(**rules))
    return named.where(F.size("failed_rules") == 0).drop("failed_rules"), named.where(F.size("failed_rules") > 0)


def drop_empty(df: DataFrame, col: str = "content") -> tuple[DataFrame, Observation]:
    """Rows with content, and an observation whose 'dropped' is known after the first action, without a second pass.

    Only '' and null are empty; white space is content.
    """
    seen = Observation()
    n = F.coalesce(F.length(col), F.lit(0))
    return df.observe(seen, F.count_if(n == 0).alias("dropped"), F.count_if(n > 0).alias("kept")).where(n > 0), seen


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id given, content of 1 to MAX_CONTENT characters."""
    n = F.coalesce(F.length("content"), F.lit(0))
    return split_by_rules(df, id=F.coalesce(F.col("id"), F.lit("")) == "", content_empty=n == 0, content_long=n > MAX_CONTENT)


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prompt 1..4000 characters, max_codes 1..50, threshold 0..1 or null, mode and period of their lists (period may be null), one record at least."""
    n = F.coalesce(F.length("prompt"), F.lit(0))
    return split_by_rules(
        df,
        prompt=(n < 1) | (n > 4000),
        max_codes=~F.col("max_codes").between(1, 50),
        threshold=~F.col("threshold").between(0, 1),
        mode=~F.coalesce(F.col("mode").isin("single_pass", "hierarchical"), F.lit(False)),
        period=~F.col("period").isin("day", "week", "month"),
        n_records=F.coalesce(F.col("n_records"), F.lit(0)) < 1,
    )


def check_metadata_keys(df: DataFrame, col: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """Good rows with the known keys alone (deprecated ones are taken and left out), and rows with unknown ones, listed."""
    unknown = F.array_sort(F.array_except(F.map_keys(col), F.array(*[F.lit(k) for k in (*METADATA_KEYS, *DEPRECATED_KEYS)])))
    named = df.withColumn("unknown_keys", F.coalesce(unknown, F.array().cast("array<string>")))
    good = named.where(F.size("unknown_keys") == 0).drop("unknown_keys").withColumn(col, F.map_filter(col, lambda k, v: ~k.isin(*DEPRECATED_KEYS)))
    return good, named.where(F.size("unknown_keys") > 0)


def project_metadata(df: DataFrame, col: str = "metadata") -> DataFrame:
    """A rich metadata map cut to the known keys, as a struct; created is '' where missing."""
    m = F.col(col)
    return df.withColumn(col, F.struct(F.coalesce(m["created"], F.lit("")).alias("created"), *[m[k].alias(k) for k in METADATA_KEYS[1:]]))


def check_calls(df: DataFrame) -> DataFrame:
    """Log rows that break a constraint: no negative figures, status and operation of their lists, error_class exactly on errors."""
    rules = {c: F.col(c) < 0 for c in ("call_duration_ms", "input_tokens", "output_tokens", "cost_usd")}
    rules |= {"status": ~F.col("status").isin(*STATUSES), "operation": ~F.col("operation").isin(*OPERATIONS), "error_class": F.col("error_class").isNotNull() != (F.col("status") == "error")}
    return split_by_rules(df, **rules)[1]


# The screens, in the order in which the first match names the reason.
SCREENS = (("role_prefix", r"(?iU)^\s*(SYSTEM|ASSISTANT|USER)\s*:"), ("null_byte", r"\x00"), ("repeated_chars", r"(?d)(.)\1{199,}"))


def injection(col: Column) -> Column:
    """The name of the first screen that a text matches, or null."""
    return F.coalesce(*[F.when(col.rlike(p), F.lit(name)) for name, p in SCREENS])


def screen_injection(df: DataFrame, col: str = "content") -> DataFrame:
    """Adds injection: the first screen that matches, or null."""
    return df.withColumn("injection", injection(F.col(col)))


def with_token_estimate(df: DataFrame, cols: list[str], chars_per_token: int = 4, limit: int = 100_000) -> DataFrame:
    """Adds estimated_tokens = floor(characters / chars_per_token) over cols, and over_limit."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    est = F.floor(chars / chars_per_token).cast("bigint")
    return df.withColumns({"estimated_tokens": est, "over_limit": est > limit})


def empty_results(df: DataFrame, operation: str) -> DataFrame:
    """What an operation gives for input without content: one row for each (corpus_id or id)."""
    none = lambda t: F.lit(None).cast(t)
    cols = {
        "analyze": {"analysis": F.lit(DISCLAIMER), "quality_score": none("double"), "explanation": F.lit(NO_CONTENT), "record_count": F.lit(0), "confidence": none("double")},
        "summarize": {"title": F.lit(""), "summary": F.lit(""), "quality_score": F.lit(0.0)},
        "assign_codes": {"codes": F.array().cast("array<string>")},
        "detect_sensitive": {"is_sensitive": F.lit(False), "explanation": F.lit(NO_SENSITIVE_CONTENT), "sensitivity_types": F.array().cast("array<string>")},
    }[operation]
    return df.withColumns(cols)
