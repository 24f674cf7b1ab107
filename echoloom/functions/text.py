"""Column functions on text: cleaning, escaping, languages, scores, parsing of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_newlines(col: Column) -> Column:
    """Line feeds become spaces, carriage returns go."""
    return F.translate(col, "\n\r", " ")


def escape_envelope(col: Column) -> Column:
    """The five characters that matter inside a tag envelope, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def quote_attribute(col: Column) -> Column:
    """An attribute value with its quotes: double ones, or single ones where it holds a double quote and no single one."""
    s = col
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    double, single = F.contains(col, F.lit('"')), F.contains(col, F.lit("'"))
    both = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(double & single, both).when(double, F.concat(F.lit("'"), s, F.lit("'"))).otherwise(F.concat(F.lit('"'), s, F.lit('"')))


def language_suffix(language: Column, subject: str = "analysis") -> Column:
    """The sentence that asks for an output language; empty without one."""
    return F.when(F.coalesce(language, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"\n\nUse this language for the {subject}: "), language, F.lit(".")))


def _nfc(col: Column) -> Column:
    import unicodedata

    def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    # The hints are given as objects: the module's annotations are strings.
    compose.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(compose, "string")(col)


LANGUAGE_MAX = 50


def sanitize_language(col: Column, nfc: bool = True) -> Column:
    """A free-text language name made harmless; null when nothing is left.

    The first 20 x LANGUAGE_MAX characters count. White space is collapsed, only letters, marks, spaces and - ( ) '
    stay, LANGUAGE_MAX characters at most. Composition (NFC) has no built-in function, so rows that are not plain
    ASCII go through a pandas function; nfc=False leaves it out.
    """
    v = F.trim(F.regexp_replace(F.substring(col, 1, 20 * LANGUAGE_MAX), r"(?U)\s+", " "))
    if nfc:
        v = F.when(v.rlike(r"^[\x00-\x7F]*$"), v).otherwise(_nfc(F.when(~v.rlike(r"^[\x00-\x7F]*$"), v)))
    v = F.regexp_replace(v, r"[^\p{L}\p{M} \-()']", "")
    v = F.trim(F.substring(F.trim(F.regexp_replace(v, " +", " ")), 1, LANGUAGE_MAX))
    return F.when(v != "", v)


# Names and codes of languages, headers of the pretty block.
LANGUAGES = {"english": "en", "en": "en", "french": "fr", "fr": "fr", "spanish": "es", "es": "es", "arabic": "ar", "ar": "ar", "russian": "ru", "ru": "ru", "dutch": "nl", "nl": "nl", "ukrainian": "uk", "uk": "uk"}
HEADERS = {
    "quality": {"en": "QUALITY", "fr": "QUALITÉ", "es": "CALIDAD", "ar": "الجودة", "ru": "КАЧЕСТВО", "nl": "KWALITEIT", "uk": "ЯКІСТЬ"},
    "title": {"en": "TITLE", "fr": "TITRE", "es": "TÍTULO", "ar": "العنوان", "ru": "ЗАГОЛОВОК", "nl": "TITEL", "uk": "ЗАГОЛОВОК"},
    "summary": {"en": "SUMMARY", "fr": "RÉSUMÉ", "es": "RESUMEN", "ar": "ملخص", "ru": "СВОДКА", "nl": "SAMENVATTING", "uk": "ПІДСУМОК"},
}
DOTS = ((0.9, "●●●●●"), (0.7, "●●●●○"), (0.5, "●●●○○"), (0.3, "●●○○○"), (0.1, "●○○○○"))


def resolve_language(df: DataFrame, col: str, out: str = "language_code") -> DataFrame:
    """Adds the code of a language name or code (en if there is none or it is not supported) and out_unsupported."""
    pairs = df.sparkSession.createDataFrame(list(LANGUAGES.items()), "_alias string, _code string")  # a fixed small table
    key = F.lower(F.trim(col))
    joined = df.join(F.broadcast(pairs), key == F.col("_alias"), "left")
    given = F.coalesce(key, F.lit("")) != ""
    return joined.withColumns({out: F.coalesce("_code", F.lit("en")), f"{out}_unsupported": given & F.col("_code").isNull()}).drop("_alias", "_code")


def quality_dots(score: Column) -> Column:
    """Five dots; null stays null, NaN counts as none."""
    out = F.when(F.isnan(score), F.lit("○○○○○"))
    for least, dots in DOTS:
        out = out.when(score >= least, F.lit(dots))
    return out.when(score.isNotNull(), F.lit("○○○○○"))


def _header(kind: str, code: Column) -> Column:
    out = F.lit(HEADERS[kind]["en"])
    for k, v in HEADERS[kind].items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return F.concat(out, F.lit(":"))


def _padded(label: Column) -> Column:
    return F.concat(label, F.repeat(F.lit(" "), F.greatest(F.lit(16) - F.length(label), F.lit(0))))


def pretty_output(code: Column, id: Column | None = None, ids: Column | None = None, score: Column | None = None, title: Column | None = None, summary: Column | None = None) -> Column:
    """A block of text for people; lines of null values are left out. Percentages round half to even."""
    none = F.lit(None).cast("string")
    lines = [
        none if id is None else F.concat(F.lit("Feedback-ID:    "), id),
        none if ids is None else F.concat(F.lit("IDs:            "), F.array_join(ids, ", ")),
        none if score is None else F.concat(_padded(_header("quality", code)), quality_dots(score), F.lit(" "), F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%")),
        none if title is None else F.concat(_padded(_header("title", code)), title),
        none if summary is None else F.concat(_header("summary", code), F.lit("\n"), summary),
        F.lit("-" * 60),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def sentence_count(col: Column) -> Column:
    """Parts between ends of sentences or lines that are not blank; 1 at least, 0 for an empty text."""
    parts = F.size(F.filter(F.split(F.trim(col), r"[.!?]+\s+|\n"), lambda p: F.trim(p) != ""))
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", 0).otherwise(F.greatest(parts, F.lit(1)))


def parse_score(col: Column) -> Column:
    """struct(score, reason): the first line as a number in [0, 1], else null and why."""
    first = F.trim(F.split(F.trim(col), "\n")[0])
    n = F.try_cast(first, "double") if hasattr(F, "try_cast") else first.try_cast("double")
    bad = F.when(col.isNull(), "missing").when(n.isNull(), "not a number").when(F.isnan(n) | (n < 0) | (n > 1), "out of range")
    return F.struct(F.when(bad.isNull(), n).alias("score"), bad.alias("reason"))


def parse_selected(col: Column, n: Column | int) -> Column:
    """The option numbers of {"selected": [...]}: whole numbers from 0 to below n, each once, in order; anything else is left out.

    Numbers with a fraction are cut, true and false are 1 and 0.
    """
    items = F.from_json(col, "struct<selected:array<string>>")["selected"]
    text = F.filter(items, lambda x: x.isNotNull())
    num = F.transform(text, lambda x: F.when(F.lower(x) == "true", 1.0).when(F.lower(x) == "false", 0.0).otherwise(x.try_cast("double")))
    whole = F.transform(F.filter(num, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)), lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int"))
    top = F.lit(n) if isinstance(n, int) else n
    return F.coalesce(F.array_distinct(F.filter(whole, lambda x: (x >= 0) & (x < top))), F.array().cast("array<int>"))


def parse_structured(df: DataFrame, col: str, schema: str, rules: dict[str, Column], out: str = "parsed") -> DataFrame:
    """Adds out (the answer as a struct, null if it cannot be used) and out_error (what is wrong with it, or null).

    rules: name -> condition over the struct's fields (written as F.col('parsed.x')) that is true where the rule is broken.
    """
    read = df.withColumn(out, F.from_json(col, schema))
    fields = [f for f in read.schema[out].dataType.names]
    missing = F.col(out).isNull() | (F.size(F.filter(F.array(*[F.col(f"{out}.`{f}`").cast("string") for f in fields]), lambda x: x.isNotNull())) == 0)
    error = F.when(missing, F.lit("unreadable"))
    for name, broken in rules.items():
        error = error.when(broken, F.lit(name))
    return read.withColumn(f"{out}_error", error).withColumn(out, F.when(F.col(f"{out}_error").isNull(), F.col(out)))


def coerce_cost(col: Column) -> Column:
    """Null, NaN and negative costs are 0; the rest as decimal(12,6)."""
    ok = col.isNotNull() & ~F.isnan(col.cast("double")) & (col >= 0)
    return F.when(ok, F.when(ok, col).cast("decimal(12,6)")).otherwise(F.lit(0).cast("decimal(12,6)"))


def parent_path(col: Column) -> Column:
    """All but the last part of a path with colons; the path itself if it has one part."""
    return F.when(F.contains(col, F.lit(":")), F.regexp_replace(col, ":[^:]*$", "")).otherwise(col)


def leaf_short(col: Column) -> Column:
    return F.element_at(F.split(col, ":", -1), -1)

