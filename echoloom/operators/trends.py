"""How often each coding label occurs in each period, per corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_of

FIELDS = ("coding_level_1",)
DEFAULT_PERIOD = "week"


def labels_of(fields: tuple[str, ...]) -> Column:
    """The labels of a record: of each field in turn, split at commas, trimmed, blanks left out, duplicates kept."""
    return F.filter(F.transform(F.split(F.concat_ws(",", *fields), ","), lambda x: F.trim(x)), lambda x: x != "")


def explode_codes(df: DataFrame, fields: tuple[str, ...] = FIELDS, keep: list[str] | None = None) -> DataFrame:
    """A row for each label of each record."""
    return df.select(*(keep if keep is not None else df.columns), F.explode(labels_of(fields)).alias("code"))


def coding_trends(df: DataFrame, by: str = "corpus_id", fields: tuple[str, ...] = FIELDS, period: str | None = None, date: str = "created") -> DataFrame:
    """(by, code, period, count). Records without a date do not count; a label twice in a record counts twice."""
    rows = df.select(by, period_of(F.col(date), period or DEFAULT_PERIOD).alias("period"), *fields).where("period is not null")
    return explode_codes(rows, fields, [by, "period"]).groupBy(by, "code", "period").agg(F.count("*").alias("count"))


def trend_periods(df: DataFrame, by: str = "corpus_id", period: str | None = None, date: str = "created") -> DataFrame:
    """(by, periods): all periods with a dated record, coded or not, sorted. Corpora without one are left out."""
    rows = df.select(by, period_of(F.col(date), period or DEFAULT_PERIOD).alias("period")).where("period is not null").distinct()
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("period")).alias("periods"))


def trend_diagnostics(df: DataFrame, by: str = "corpus_id", fields: tuple[str, ...] = FIELDS, period: str | None = None, date: str = "created") -> DataFrame:
    """(by, n_records, n_dated, n_dated_uncoded, no_date)."""
    dated = period_of(F.col(date), period or DEFAULT_PERIOD).isNotNull()
    coded = F.size(labels_of(fields)) > 0
    out = df.groupBy(by).agg(F.count("*").alias("n_records"), F.count_if(dated).alias("n_dated"), F.count_if(dated & ~coded).alias("n_dated_uncoded"))
    return out.withColumn("no_date", F.col("n_dated") == 0)


def render_trends(cells: DataFrame, periods: DataFrame, by: str = "corpus_id") -> DataFrame:
    """(by, grid): a CSV text for each corpus, a row for each code, zeros where a code has no cell.

    The grid is codes x periods of one corpus, the size of the answer. A corpus without codes has the head line alone.
    """
    row = F.map_from_entries(F.collect_list(F.struct("period", "count")))
    codes = cells.groupBy(by, "code").agg(row.alias("_m"))
    wide = codes.join(periods, by).withColumn("line", F.concat_ws(",", "code", F.array_join(F.transform("periods", lambda p: F.coalesce(F.col("_m")[p], F.lit(0)).cast("string")), ",")))
    lines = wide.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat_ws(",", F.lit("code"), F.array_join("periods", ","))
    return periods.join(lines, by, "left").select(by, F.concat_ws("\n", head, "lines").alias("grid"))


def trends_as_struct(cells: DataFrame, periods: DataFrame, by: str = "corpus_id") -> DataFrame:
    """(by, periods, cells): the cells as a sorted array of structs."""
    nested = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("code", "period", "count"))).alias("cells"))
    none = F.array().cast(nested.schema["cells"].dataType)
    return periods.join(nested, by, "left").withColumn("cells", F.coalesce("cells", none))


def top_varying_codes(cells: DataFrame, k: int = 8) -> DataFrame:
    """The k codes whose counts per period vary most (sample deviation, nulls last, ties by code)."""
    per = cells.groupBy("code", "period").agg(F.sum("count").alias("count")).groupBy("code").agg(F.stddev_samp("count").alias("std"), F.sum("count").alias("total"))
    return per.orderBy(F.col("std").desc_nulls_last(), "code").limit(k)


def pivot_trends(cells: DataFrame, codes: DataFrame, periods: list[str]) -> DataFrame:
    """Chosen codes by period, one column each, nulls as 0."""
    chosen = cells.join(codes.select("code"), "code", "left_semi")
    return chosen.groupBy("code").pivot("period", periods).agg(F.sum("count")).na.fill(0)
