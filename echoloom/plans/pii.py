"""Queries on pseudonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pii as P
from ..operators import recognise as R
from ..operators.validate import DISCLAIMER
from ..views import view, with_views


def _records(spark, d):
    return view(spark, d, "records").select("id", "corpus_id", "content", "pos")


def _spans(spark, d):
    return P.detect_entities(_records(spark, d), "id", "content")


def _typed(spark, d):
    """Spans, some under labels that are ignored or stay."""
    t = F.when(F.col("start") % 7 == 0, "CARDINAL").when(F.col("start") % 11 == 0, "DATE_TIME").otherwise(F.col("type"))
    return _spans(spark, d).withColumn("type", t)


def c1_entities(spark, d):
    return _spans(spark, d)


def c2_filtered(spark, d):
    return P.filter_entities(_typed(spark, d), verbatim=("NOTHING",))


def c3_verbatim(spark, d):
    return P.filter_entities(_typed(spark, d))


def c4_resolved(spark, d):
    wide = _spans(spark, d)
    also = wide.select("id", (F.col("start") + 2).cast("int").alias("start"), (F.col("end") + 3).cast("int").alias("end"), F.lit("X").alias("type"), F.lit("x").alias("value"))
    return P.resolve_spans(wide.unionByName(also), "id").select("id", "start", "end", "type")


def c5_placeholders(spark, d):
    return P.number_placeholders(P.resolve_spans(_spans(spark, d), "id"), ["id"], ["start"])


def c7_pseudonymised(spark, d):
    out, _ = P.pseudonymise_records(_records(spark, d))
    return out.select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


def c7_mapping(spark, d):
    return P.pseudonymise_records(_records(spark, d))[1]


def c8_restored(spark, d):
    out, mapping = P.pseudonymise_records(_records(spark, d))
    return P.restore(out, mapping, "corpus_id", "content", id_col="id").select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


def c9_retained(spark, d):
    out, mapping = P.pseudonymise_records(_records(spark, d))
    return P.restore(out, mapping, "corpus_id", "content", retain=("EMAIL_ADDRESS",), id_col="id").select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


def c10_disclaimed(spark, d):
    return P.with_disclaimer(_records(spark, d), "content").select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


def c11_leaks(spark, d):
    r = _records(spark, d)
    out, mapping = P.pseudonymise_records(r)
    half = out.unionByName(r.where("pos % 2 = 0").withColumn("id", F.concat("id", F.lit("-raw"))))
    return P.audit_leaks(half, mapping, "corpus_id", "id", "content")


def _recognised(spark, d):
    """Three in a hundred texts fail with their whole batch, two in a hundred get a span that is none."""
    r = view(spark, d, "records").select("id", "corpus_id", "content", "language")
    return R.pseudonymise_recognised(r, R.stub_recogniser(0.03, 0.05), language="language")


def k3_recognised(spark, d):
    out, _ = _recognised(spark, d)
    return out.select("id", F.md5(F.col("content").cast("binary")).alias("digest"), "error_class")


def k3_mapping(spark, d):
    return _recognised(spark, d)[1]


def k3_spans(spark, d):
    """Spans and failures as the recogniser gives them, before any rule."""
    r = view(spark, d, "records").select("id", "content", "language")
    return R.recognise(r, R.stub_recogniser(0.03, 0.05), "id", "content", "language")


def c6_replaced(spark, d):
    """Spans of every record replaced by their type, on whole texts."""
    s = P.resolve_spans(_spans(spark, d), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.concat(F.lit("["), "type", F.lit("]")).alias("placeholder")))).alias("spans"))
    r = _records(spark, d).join(s, "id")
    return r.select("id", F.md5(P.replace_spans(F.col("content"), F.col("spans")).cast("binary")).alias("digest"), F.size("spans").cast("bigint").alias("n"))


_ONE = " UNION ALL ".join(
    f"SELECT id, corpus_id, content, '{t}' AS type, unnest(h) AS value, unnest(range(1, len(h) + 1)) AS k, h, g FROM (SELECT id, corpus_id, content, regexp_extract_all(content, '{p}') AS h, string_split_regex(content, '{p}') AS g FROM records)" for t, p in P.DETECTORS.items()
)
_SPANS = f"""m AS ({_ONE}), spans AS (SELECT id, corpus_id, CAST(s AS INT) AS start, CAST(s + len(value) AS INT) AS "end", type, value FROM
  (SELECT *, list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: len(x))), 0) AS s FROM m))"""
_RESOLVED = """res AS (SELECT * EXCLUDE (c) FROM (SELECT *, max("end") OVER (PARTITION BY id ORDER BY start, "end" DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM spans) WHERE c IS NULL OR c <= start)"""
_MAP = """f AS (SELECT corpus_id, type, value, min((id, start)) AS seen FROM res GROUP BY ALL), map AS (SELECT corpus_id, '<' || type || '_' || (row_number() OVER (PARTITION BY corpus_id ORDER BY seen, type, value) - 1) || '>' AS placeholder, type, value FROM f)"""


def _replaced(value: str) -> str:
    return f"""own AS (SELECT r.*, placeholder, CAST({value} AS VARCHAR) AS new FROM res r JOIN map USING (corpus_id, type, value)),
      bits AS (SELECT id, start, new, "end", coalesce(lag("end") OVER (PARTITION BY id ORDER BY start), 0) AS prev FROM own),
      put AS (SELECT b.id, string_agg(substr(content, prev + 1, start - prev) || new, '' ORDER BY start) || substr(any_value(content), max("end") + 1) AS content FROM bits b JOIN records r ON r.id = b.id GROUP BY b.id),
      out AS (SELECT r.id, r.corpus_id, r.pos, coalesce(put.content, r.content) AS content FROM records r LEFT JOIN put ON put.id = r.id)"""


_TYPED = "typed AS (SELECT id, start, \"end\", CASE WHEN start % 7 = 0 THEN 'CARDINAL' WHEN start % 11 = 0 THEN 'DATE_TIME' ELSE type END AS type, value FROM spans)"
_IGN = ", ".join(f"'{x}'" for x in P.IGNORED)
_BASE = f"WITH {_SPANS}, {_RESOLVED}, {_MAP}"
_DISC = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in DISCLAIMER.split("\n"))

_UNIT = "(CAST(('0x' || substr(md5(content), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
_FAILED = f"CASE WHEN content IS NULL OR content = '' THEN NULL WHEN {_UNIT} < 0.03 THEN 'LLMBadRequestError' WHEN {_UNIT} < 0.05 THEN 'LLMResponseError' END"
_ASKED = f"{_SPANS.replace('spans AS', 'spans0 AS')}, fail AS (SELECT id, language, {_FAILED} AS error_class FROM records), spans AS (SELECT spans0.* FROM spans0 JOIN fail ON fail.id = spans0.id WHERE error_class IS NULL AND (language = 'en' OR type = 'EMAIL_ADDRESS'))"

QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "ck" and k[1].isdigit() and callable(f)}
SQL = {
    "c1_entities": with_views(f"WITH {_SPANS} SELECT id, start, \"end\", type, value FROM spans", "records"),
    "c2_filtered": with_views(f"WITH {_SPANS}, {_TYPED} SELECT * FROM typed WHERE type NOT IN ({_IGN})", "records"),
    "c3_verbatim": with_views(f"WITH {_SPANS}, {_TYPED} SELECT * FROM typed WHERE type NOT IN ({_IGN}, 'DATE_TIME')", "records"),
    "c4_resolved": with_views(f"WITH {_SPANS.replace('spans AS', 'spans0 AS')}, spans AS (SELECT * FROM spans0 UNION ALL SELECT id, corpus_id, start + 2, \"end\" + 3, 'X', 'x' FROM spans0), {_RESOLVED} SELECT id, start, \"end\", type FROM res", "records"),
    "c5_placeholders": with_views(f"WITH {_SPANS}, {_RESOLVED}, {_MAP.replace('corpus_id', 'id')} SELECT id, placeholder, type, value FROM map", "records"),
    "c6_replaced": with_views(f"WITH {_SPANS}, {_RESOLVED}, b AS (SELECT id, start, \"end\", '[' || type || ']' AS new, coalesce(lag(\"end\") OVER (PARTITION BY id ORDER BY start), 0) AS prev FROM res) SELECT b.id, md5(string_agg(substr(content, prev + 1, start - prev) || new, '' ORDER BY start) || substr(any_value(content), max(\"end\") + 1)) AS digest, count(*) AS n FROM b JOIN records r ON r.id = b.id GROUP BY b.id", "records"),
    "k3_recognised": with_views(f"WITH {_ASKED}, {_RESOLVED}, {_MAP}, {_replaced('placeholder')} SELECT id, CASE WHEN error_class IS NULL THEN md5(content) END AS digest, error_class FROM out JOIN fail USING (id)", "records"),
    "k3_mapping": with_views(f"WITH {_ASKED}, {_RESOLVED}, {_MAP} SELECT * FROM map", "records"),
    "k3_spans": with_views(f"WITH {_ASKED} SELECT id, start, \"end\", type, value, NULL::VARCHAR AS error_class FROM spans UNION ALL SELECT id, NULL, NULL, NULL, NULL, error_class FROM fail WHERE error_class IS NOT NULL", "records"),
    "c7_pseudonymised": with_views(f"{_BASE}, {_replaced('placeholder')} SELECT id, md5(content) AS digest FROM out", "records"),
    "c7_mapping": with_views(f"{_BASE} SELECT * FROM map", "records"),
    "c8_restored": with_views("SELECT id, md5(content) AS digest FROM records", "records"),
    "c9_retained": with_views(f"{_BASE}, {_replaced(chr(67) + 'ASE WHEN type = ' + chr(39) + 'EMAIL_ADDRESS' + chr(39) + ' THEN placeholder ELSE value END')} SELECT id, md5(content) AS digest FROM out", "records"),
    "c10_disclaimed": with_views(f"SELECT id, md5({_DISC} || content) AS digest FROM records", "records"),
    "c11_leaks": with_views(f"{_BASE}, {_replaced('placeholder')}, half AS (SELECT id, corpus_id, content FROM out UNION ALL SELECT id || '-raw', corpus_id, content FROM records WHERE pos % 2 = 0) SELECT half.id, placeholder FROM half JOIN map USING (corpus_id) WHERE contains(content, value)", "records"),
}
