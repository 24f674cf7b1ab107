"""Pseudonyms for personal data. A detector gives spans; every rule after that is relational, over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled
from .numbering import number_rows
from .substrings import values_in_texts
from .validate import DISCLAIMER

# The built-in detectors, in order of their names, and labels that are not personal.
DETECTORS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "IP_ADDRESS": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "PHONE_NUMBER": r"\+[0-9][0-9 ().-]{6,18}[0-9]",
    "URL": r"https?://[A-Za-z0-9./?=_%&#-]+",
}
IGNORED = ("CARDINAL", "ORDINAL", "QUANTITY", "PERCENT", "MONEY", "FAC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "MISC")
VERBATIM = ("DATE_TIME",)
# The same matches found in linear time: an address starts where a run of its characters starts or the last match ended, and no
# character of the run is given back. With it, a string without which a text has no match.
_LINEAR = {
    DETECTORS["EMAIL_ADDRESS"]: (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9]", "@"),
    DETECTORS["PHONE_NUMBER"]: (DETECTORS["PHONE_NUMBER"], "+"),
    DETECTORS["URL"]: (DETECTORS["URL"], "://"),
}
_SPAN = "array<struct<start:int,end:int,type:string,value:string>>"


def _spans(text: Column, type: str, pattern: str) -> Column:
    """Matches of a pattern with their places, from what split leaves between them."""
    fast, needs = _LINEAR.get(pattern, (pattern, None))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(fast), F.lit(0)), F.split(text, fast, -1), lambda h, g: F.struct(h.alias("h"), g.alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        more = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(type).alias("type"), x["h"].alias("value")))
        return F.when(x["h"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], more).alias("out")))  # the last piece has no match behind it

    none = F.array().cast(_SPAN)

    def block(acc: Column, few: Column) -> Column:
        """Spans are gathered block by block, as each step copies what it adds to."""
        inner = F.aggregate(few, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(128)), lambda k: F.slice(pairs, k, F.lit(128)))
    found = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(none)


def detect_entities(df: DataFrame, id_col: str, col: str, detectors: dict[str, str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each span: id, start, end (code points, end exclusive), type, value, and columns to carry. Another recogniser's rows of this form serve as well."""
    found = F.concat(*[_spans(F.coalesce(F.col(col), F.lit("")), t, p) for t, p in (detectors or DETECTORS).items()])
    return df.select(F.col(id_col), *carry, F.explode(found).alias("_s")).select(id_col, "_s.start", "_s.end", "_s.type", "_s.value", *carry)


def filter_entities(spans: DataFrame, ignore: tuple[str, ...] = IGNORED, verbatim: tuple[str, ...] = VERBATIM) -> DataFrame:
    """Without spans of types that are not personal, or that stay as they are."""
    return spans.where(~F.col("type").isin(*ignore, *verbatim))


def resolve_spans(spans: DataFrame, id_col: str) -> DataFrame:
    """Spans that no span overlaps which starts earlier, or at the same place and ends later (then by type)."""
    w = W.partitionBy(id_col).orderBy("start", F.desc("end"), "type")
    covered = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("_c", covered).where("_c is null or _c <= start").drop("_c")


def spans_in_place(text: Column, detectors: dict[str, str] | None = None) -> Column:
    """What detect_entities, filter_entities and resolve_spans leave of a text, as an array by start (start, end, type, value): for passes that need a text and its spans together."""
    found = F.concat(*[_spans(F.coalesce(text, F.lit("")), t, p) for t, p in (detectors or DETECTORS).items()])
    personal = F.filter(found, lambda s: ~s["type"].isin(*IGNORED, *VERBATIM))
    ordered = F.array_sort(F.transform(personal, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["type"].alias("type"), s["value"].alias("value"))))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        more = F.array(F.struct(x["start"].alias("start"), end.alias("end"), x["type"].alias("type"), x["value"].alias("value")))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(acc["at"] <= x["start"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, few: Column) -> Column:
        inner = F.aggregate(few, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    blocks = F.transform(F.sequence(F.lit(1), F.size(ordered), F.lit(128)), lambda k: F.slice(ordered, k, F.lit(128)))
    kept = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, kept).otherwise(none)


def placeholder(type: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), type, F.lit("_"), n.cast("string"), F.lit(">"))


def marked(text: Column, spans: Column) -> Column:
    """text with its spans replaced as if every placeholder had the number 0. No screen tells it from the redacted text, and lengths differ by the digits of the numbers."""
    marks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), placeholder(s["type"], F.lit(0)).alias("placeholder")))
    return F.when(F.size(spans) > 0, replace_spans(text, marks)).otherwise(text)


def number_placeholders(spans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A mapping by group: placeholder <TYPE_n>, type, value. Equal values of one type share one; n counts over all types, by first appearance.

    Groups of any size are numbered in ranges, so that no task holds the values of a corpus.
    """
    first = spans.groupBy(*by, "type", "value").agg(F.min(F.struct(*order)).alias("_first_at"))
    numbered = number_rows(first, by, ["_first_at", "type", "value"], "_n")
    return numbered.select(*by, placeholder(F.col("type"), F.col("_n")).alias("placeholder"), "type", "value")


def replace_spans(text: Column, spans: Column) -> Column:
    """text with each span (start, end, placeholder; sorted, apart from each other) replaced."""

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["placeholder"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)


def pseudonymise_records(df: DataFrame, by: str = "corpus_id", id_col: str = "id", col: str = "content", spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The records with col redacted, and the mapping (by, placeholder, type, value).

    Placeholders are numbered over a whole corpus in order of record and place, so one of them means one value wherever
    it stands. Metadata stay. Spans are found once and written to the shared folder; the mapping and the records both read them there.
    """
    if spans is None:
        found = detect_entities(df, id_col, col, carry=(by,))
    else:
        found = spans if by in spans.columns else spans.join(df.select(id_col, by), id_col)
    keyed = settled(resolve_spans(filter_entities(found), id_col))
    mapping = number_placeholders(keyed, [by], [id_col, "start"])
    return redacted(df, keyed, mapping, by, id_col, col), mapping


def redacted(df: DataFrame, spans: DataFrame, mapping: DataFrame, by: str = "corpus_id", id_col: str = "id", col: str = "content") -> DataFrame:
    """The records with the spans (by, id, start, end, type, value; apart from each other) in col replaced by their placeholders."""
    own = spans.join(mapping, [by, "type", "value"]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("_spans"))
    out = df.join(own, id_col, "left").withColumn(col, F.when(F.col("_spans").isNull(), F.col(col)).otherwise(replace_spans(F.col(col), F.col("_spans"))))
    return out.select(*df.columns)


def restore(df: DataFrame, mapping: DataFrame, by: str, col: str, retain: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """col with placeholders turned back, except those of types in retain. Only placeholders that stand in a text are looked up.

    id_col names a column that says by which rows are dealt already; what is looked up then comes to the texts, which are not dealt anew. Rows may share an id; one without an id stays as it is, as it was never redacted.
    """
    marks = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit("<[A-Z_]+_[0-9]+>"), F.lit(0)))
    own = [id_col] if id_col else []
    keyed = df.withColumn("_row", F.xxhash64(by, col))
    used = keyed.select("_row", *own, by, F.explode(marks).alias("placeholder")).distinct()
    kept = mapping.where(~F.col("type").isin(*retain)) if retain else mapping
    found = used.join(kept, [by, "placeholder"]).groupBy("_row", *own).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("_map"))
    if own:  # one row of maps for each id, so that the join is by the id alone
        found = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_row", "_map"))).alias("_maps"))
        met = keyed.join(found, id_col, "left").withColumn("_map", F.col("_maps")[F.col("_row")])
    else:
        met = keyed.join(found, "_row", "left")
    pieces = F.transform(F.split(F.col(col), "(?=<[A-Z_]+_[0-9]+>)|(?<=>)"), lambda x: F.coalesce(F.col("_map")[x], x))
    return met.withColumn(col, F.when(F.col("_map").isNull(), F.col(col)).otherwise(F.array_join(pieces, ""))).select(*df.columns)


def with_disclaimer(df: DataFrame, col: str) -> DataFrame:
    """The note comes first, after restoring, so its own placeholder stays."""
    return df.withColumn(col, F.concat(F.lit(DISCLAIMER), F.coalesce(F.col(col), F.lit(""))))


def audit_leaks(df: DataFrame, mapping: DataFrame, by: str, id_col: str, col: str) -> DataFrame:
    """(id, placeholder) of original values that still stand in a redacted text of their corpus. Texts meet values on grams, not corpus by corpus."""
    return values_in_texts(df.select(by, id_col, col), mapping.select(by, "placeholder", "value"), by, col).select(id_col, "placeholder")
