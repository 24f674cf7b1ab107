"""Personal data, with DataFrame functions alone: patterns propose spans, checksums and digit counts confirm them,
context words before a span adjust its score.

The patterns are written so that matching takes time in proportion to the text even where a text
is one long run of digits or letters: repeats are possessive, and a match may start only where a
run starts or where the last match ended (\\G).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

CONTEXT_CHARS = 40
BASE = ("email", "ip", "card", "phone")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Luhn's checksum over the digits of v."""
    d = F.reverse(_digits(v))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _mod97(v: Column) -> Column:
    """The check of account numbers: first four characters last, letters as 10..35, remainder 1."""
    s = F.regexp_replace(v, "[^A-Z0-9]", "")
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97).cast("int")

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: object
    needs: str  # a character without which there is no match, or ""
    base: bool
    score: float
    context: tuple[str, ...] = field(default=())


# The kinds, in the order in which they are listed, and their context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@", True, 0.8, ("mail", "contact", "write", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(999)) <= 255), ".", True, 0.6, ("ip", "host", "server", "address", "client")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])", _luhn, "", True, 0.7, ("card", "visa", "pay", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), "+", True, 0.7, ("tel", "phone", "call", "fax", "mobile", "ruf")),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _mod97, "", False, 0.8, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}\b", lambda v: F.length(_digits(v)) == 10, "-", False, 0.3, ("tel", "phone", "call", "fax", "mobile", "ruf")),
)
#: Spans that are not of a base kind need this score.
THRESHOLD = 0.5
BONUS = 0.2

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, kind: Kind, index: int) -> Column:
    """All confirmed matches of one kind: what split() leaves between them gives their places."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("g"), h.alias("h")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["h"])
        span = F.struct(start.alias("start"), F.lit(index).alias("kind"), end.alias("end"), x["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.array().cast(SPAN)
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    if kind.valid is not None:
        found = F.filter(found, lambda s: kind.valid(s["value"]))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def _score(text: Column, s: Column) -> Column:
    """A kind's own score, more if one of its words stands in the characters before the span."""
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))))
    out = F.lit(None).cast("double")
    for i, k in reversed(list(enumerate(KINDS))):
        near = reduce(lambda a, b: a | b, [before.contains(w) for w in k.context])
        out = F.when(s["kind"] == i, F.when(near, F.lit(round(k.score + BONUS, 2))).otherwise(F.lit(k.score))).otherwise(out)
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<start, kind, end, value, score>>, by start and kind.

    start and end count code points, end exclusive. Spans of the base kinds that pass their check are always
    there; others only with a score of THRESHOLD or more, and not across a base span. Null and empty texts
    have no spans; very long texts are searched whole, repeated rows and null ids are rows like any other, other columns of any name are
    ignored, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = out.select("_id", "_text", *[_matches(text, k, i).alias(f"_{k.name}") for i, k in enumerate(KINDS)])
    base, extra = ([f"_{k.name}" for k in KINDS if k.base == b] for b in (True, False))
    out = out.select("_id", "_text", F.concat(*base).alias("_base"), F.concat(*extra).alias("_extra"))
    scored = lambda arr: F.transform(arr, lambda s: s.withField("score", _score(F.col("_text"), s)))
    fresh = F.filter("_extra", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.select("_id", scored(F.col("_base")).alias("_base"), scored(fresh).alias("_extra"))
    return out.select(F.col("_id").alias(id_col), F.array_sort(F.concat("_base", F.filter("_extra", lambda s: s["score"] >= THRESHOLD))).alias("spans"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the text with every span replaced by <KIND>. Where spans overlap the first one counts."""
    found = detect(docs.select(F.struct(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).alias("_t")), "_row", "_t")
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(kind_name(s["kind"])), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return found.select(F.col(f"_row.`{id_col}`").alias(id_col), F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end).alias("text"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


# ---------------------------------------------------------------- SQL

# The plain patterns: DuckDB's matcher takes linear time by itself.
_PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    KINDS[4].pattern,
    KINDS[5].pattern,
)
_VALID = (
    "true",
    "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR TRY_CAST(right(p, 9) AS INT) > 255)) = 0",
    "len(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(g[-i] AS INT) > 9 THEN 2 * CAST(g[-i] AS INT) - 9 ELSE 2 * CAST(g[-i] AS INT) END ELSE CAST(g[-i] AS INT) END)) % 10 = 0",
    "len(g) BETWEEN 9 AND 15",
    "list_reduce(list_prepend(0, list_transform(string_split(substr(regexp_replace(v, '[^A-Z0-9]', '', 'g'), 5) || substr(regexp_replace(v, '[^A-Z0-9]', '', 'g'), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END)), lambda a, b: CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1",
    "len(g) = 10",
)


def _sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT doc_id, t, {i} AS kind, unnest(h) AS v, unnest(range(1, len(h) + 1)) AS k, gaps, h FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS gaps FROM d)" for i, p in enumerate(_PLAIN)
    )
    near = lambda k: "(" + " OR ".join(f"contains(before, '{w}')" for w in k.context) + ")"
    score = "CASE kind " + " ".join(f"WHEN {i} THEN CASE WHEN {near(k)} THEN {round(k.score + BONUS, 2)} ELSE {k.score} END" for i, k in enumerate(KINDS)) + " END"
    valid = "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VALID)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(KINDS)) + " END"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({one}),
    p AS (SELECT doc_id, t, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS g,
      CAST(list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS s FROM m),
    c AS (SELECT doc_id, kind, s, s + len(v) AS e, lower(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS}))) AS before FROM p WHERE {valid}),
    z AS (SELECT *, {name} || ':' || s || ':' || e AS x, CAST({score} AS DOUBLE) AS score FROM c),
    o AS (SELECT * FROM z WHERE kind < 4 OR (score >= {THRESHOLD} AND NOT EXISTS (SELECT 1 FROM z b WHERE b.doc_id = z.doc_id AND b.kind < 4 AND b.s < z.e AND z.s < b.e)))
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card,
      count(*) FILTER (WHERE kind = 3) AS n_phone, sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 4), '')) AS base_sha256,
      coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, kind), '') AS scores
    FROM d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id"""


QUERIES = {"op3_pii": op3_pii}
SQL = {"op3_pii": _sql()}
