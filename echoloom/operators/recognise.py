"""Entity recognition by a pluggable model as a Spark job: texts in batches, spans as rows, failures as rows; no text that was not looked at leaves the job."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .complete import BAD_ANSWER, error_class
from .pii import DETECTORS, pseudonymise_records

BATCH = 64
UNKNOWN = "xx"

#: What a recogniser gets: (text, language) pairs; what it gives: for each the spans (start, end, type) in code points, end exclusive, or an exception.
Recognise = Callable[[list[tuple[str, str]]], list]


def _checked(text: str, got) -> list | BaseException:
    """The spans of a text; an error where the answer is none, or a span does not lie in the text, is empty or has no type."""
    if isinstance(got, BaseException):
        return got
    try:
        spans = [(int(s), int(e), t) for s, e, t in got]
    except (TypeError, ValueError):
        return TypeError("not spans")
    return spans if all(0 <= s < e <= len(text) and isinstance(t, str) and t for s, e, t in spans) else TypeError("not spans of this text")


def recognise_batch(fn: Recognise, pairs: list[tuple[str, str]]) -> list:
    """Spans or an error for each pair. Where a batch fails as a whole, its texts are asked for one by one, so what a text gets does not depend on its neighbours."""
    try:
        got = fn(pairs)
        if len(got) != len(pairs):
            raise TypeError(f"{len(got)} answers to {len(pairs)} texts")
    except Exception as e:  # noqa: BLE001  an error is a row
        got = [e] if len(pairs) == 1 else [recognise_batch(fn, [p])[0] for p in pairs]
    return [_checked(p[0], g) for p, g in zip(pairs, got, strict=True)]


def recognise(df: DataFrame, make: Callable[[], Recognise], id_col: str, col: str, language: str | None = None, carry: tuple[str, ...] = (), batch: int = BATCH) -> DataFrame:
    """A row for each span (id, start, end, type, value, error_class null, and columns to carry), and one for each text that failed, with an error_class and no span.

    make is called once in a Python worker and returns the recogniser. Each text is tagged with its value in the column `language`, xx
    where that is null or no column is named. Texts that are null or empty are not sent and give no row. Rows that repeat an id are looked at each for itself.
    """
    text = [F.col(col).alias("_text"), (F.coalesce(F.col(language), F.lit(UNKNOWN)) if language else F.lit(UNKNOWN)).alias("_language")]
    todo = df.where(F.length(col) > 0).select(F.col(id_col), *carry, *text)
    kept = [id_col, *carry]
    found = "array<struct<start:int,end:int,type:string,error_class:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("error_class", pa.string())]))

    def rows(got) -> list[dict]:
        if isinstance(got, BaseException):
            return [{"start": None, "end": None, "type": None, "error_class": BAD_ANSWER if isinstance(got, TypeError) else error_class(got)}]
        return [{"start": s, "end": e, "type": t, "error_class": None} for s, e, t in sorted(set(got))]

    def run(batches):
        fn = make()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                pairs = list(zip(part.column("_text").to_pylist(), part.column("_language").to_pylist(), strict=True))
                spans = pa.array([rows(g) for g in recognise_batch(fn, pairs)], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, spans], names=[*part.schema.names, "_found"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields) + f", _found {found}"
    each = todo.mapInArrow(run, schema).select(*kept, "_text", F.explode("_found").alias("_s"))
    value = F.substring("_text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    return each.select(id_col, "_s.start", "_s.end", "_s.type", value.alias("value"), "_s.error_class", *carry)


def pseudonymise_recognised(df: DataFrame, make: Callable[[], Recognise], by: str = "corpus_id", id_col: str = "id", col: str = "content", language: str | None = None, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The records with col redacted by a recogniser's spans and a column error_class, and the mapping (by, placeholder, type, value).

    A record whose recognition failed has an error_class and null in col: its text may hold anything, so it does not go on. If rows share an
    id and one of them fails, all of them do. The recogniser runs once; its spans are written to the shared folder. A column error_class of df is replaced.
    """
    found = settled(recognise(df, make, id_col, col, language, (by,), batch))
    out, mapping = pseudonymise_records(df.drop("error_class"), by, id_col, col, found.where("error_class is null").drop("error_class"))
    failed = found.where("error_class is not null").groupBy(id_col).agg(F.min("error_class").alias("error_class"))
    bad = F.col("error_class").isNotNull()
    return out.join(failed, id_col, "left").withColumn(col, F.when(~bad, F.col(col))).select(*out.columns, "error_class"), mapping


# ---------------------------------------------------------------- recogniser for tests and dry runs


def stub_recogniser(fail_below: float = 0.0, bad_below: float = 0.0, everywhere: tuple[str, ...] = ("EMAIL_ADDRESS",)) -> Callable[[], Recognise]:
    """The built-in detectors as a recogniser, all of them for English and `everywhere` for other languages.

    By the digest of a text, the share fail_below of them raises an error that takes its whole batch along, and the share up to bad_below gets a span outside the text.
    """

    def make() -> Recognise:
        import regex

        from .complete import _unit
        from .pii import _LINEAR

        patterns = {t: regex.compile(_LINEAR.get(p, (p, None))[0]) for t, p in DETECTORS.items()}

        def one(text: str, language: str) -> list:
            u = _unit(text)
            if u < fail_below:
                raise ValueError("stub")
            if u < bad_below:
                return [(0, len(text) + 1, "PERSON")]
            return [(m.start(), m.end(), t) for t, p in patterns.items() if language == "en" or t in everywhere for m in p.finditer(text)]

        return lambda pairs: [one(t, lang) for t, lang in pairs]

    return make
