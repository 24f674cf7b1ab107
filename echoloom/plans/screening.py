"""Queries on validation, screening, text functions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import prompts as P
from ..functions import text as T
from ..operators import validate as V
from ..views import view, with_views


def _records(spark, d):
    return view(spark, d, "records")


def _odd(spark, d):
    """Records, some with their content emptied or led by a role, a NUL byte or a run of one character."""
    c, p = F.col("content"), F.col("pos")
    made = F.when(p % 13 == 0, "").when(p % 17 == 0, F.concat(F.lit("  System : "), c)).when(p % 19 == 0, F.concat(c, F.lit("\x00"))).otherwise(c)
    return _records(spark, d).withColumn("content", made).withColumn("id", F.when(p % 23 == 0, "").otherwise(F.col("id")))


_ODD = """odd AS (SELECT * REPLACE (CASE WHEN pos % 13 = 0 THEN '' WHEN pos % 17 = 0 THEN '  System : ' || content WHEN pos % 19 = 0 THEN content || chr(0) ELSE content END AS content,
  CASE WHEN pos % 23 = 0 THEN '' ELSE id END AS id) FROM records)"""


def b1_drop_empty(spark, d):
    kept, _ = V.drop_empty(_odd(spark, d))
    return kept.groupBy("corpus_id").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def b2_empty_results(spark, d):
    empty = _odd(spark, d).where("content = ''").select("id")
    a = V.empty_results(empty, "detect_sensitive")
    return a.select("id", "is_sensitive", "explanation", F.size("sensitivity_types").alias("n_types"))


def b3_quarantine(spark, d):
    _, bad = V.validate_records(_odd(spark, d))
    return bad.select("pos", F.array_join("failed_rules", ",").alias("failed_rules"))


def b4_bad_requests(spark, d):
    r = view(spark, d, "events").select(
        "event_id", F.repeat(F.lit("p"), (F.col("event_id") % 50 * 100).cast("int")).alias("prompt"), (F.col("event_id") % 60).alias("max_codes"), ((F.col("event_id") % 15) / 10 - 0.2).alias("threshold"),
        F.when(F.col("event_id") % 3 == 0, "hierarchical").when(F.col("event_id") % 3 == 1, "single_pass").otherwise("fast").alias("mode"), F.when(F.col("event_id") % 4 == 0, "day").when(F.col("event_id") % 4 == 1, "year").alias("period"), (F.col("event_id") % 7).alias("n_records"),
    )
    return V.validate_requests(r)[1].select("event_id", F.array_join("failed_rules", ",").alias("failed_rules"))


def _with_map(spark, d):
    extra = F.when(F.col("pos") % 6 == 0, F.create_map(F.lit("colour"), F.lit("red"))).when(F.col("pos") % 6 == 1, F.create_map(F.lit("feedback_record_id"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("created"), F.col("created"), F.lit("coding_level_1"), F.col("coding_level_1"))
    return _records(spark, d).select("id", F.map_concat(base, extra).alias("metadata"))


def b5_unknown_keys(spark, d):
    return V.check_metadata_keys(_with_map(spark, d))[1].select("id", F.array_join("unknown_keys", ",").alias("unknown_keys"))


def b6_projected(spark, d):
    good = V.project_metadata(_with_map(spark, d))
    return good.select("id", "metadata.created", "metadata.coding_level_1", "metadata.coding_level_2")


def b8_screened(spark, d):
    return V.screen_injection(_odd(spark, d)).select("pos", "injection")


def b9_token_estimates(spark, d):
    return V.with_token_estimate(_records(spark, d), ["content"], 4, 1000).select("id", "estimated_tokens", "over_limit")


def b10_clean(spark, d):
    return _records(spark, d).select("id", F.md5(T.clean_newlines(F.col("content")).cast("binary")).alias("digest"))


def b11_escaped(spark, d):
    return view(spark, d, "pages").select("page_id", F.md5(T.escape_envelope(F.col("html")).cast("binary")).alias("digest"))


_META = ("created", "coding_level_1", "coding_level_2", "coding_level_3")


def _blocks(spark, d):
    return _records(spark, d).withColumn("block", P.record_envelope(F.col("content"), F.concat("id", F.when(F.col("pos") % 10 == 0, '"').otherwise("")), {k: F.col(k) for k in _META}))


def b12_record_envelopes(spark, d):
    return _blocks(spark, d).select("pos", F.md5(F.col("block").cast("binary")).alias("digest"))


def b13_batch_envelopes(spark, d):
    return P.records_envelope(_blocks(spark, d), ["corpus_id"], "pos", "block").select("corpus_id", "n_records", F.md5(F.col("records").cast("binary")).alias("digest"))


def b14_analyze_messages(spark, d):
    m = P.records_envelope(_blocks(spark, d), ["corpus_id"], "pos", "block")
    return m.select("corpus_id", F.md5(P.analyze_message(F.concat(F.lit("What about <"), "corpus_id", F.lit(">?")), F.col("records")).cast("binary")).alias("digest"))


def b16_judge_messages(spark, d):
    r = _records(spark, d)
    return r.select("id", F.md5(P.judge_message(F.col("content"), F.lit("Why {x} 100%?"), F.col("language")).cast("binary")).alias("digest"))


def b17_reduce_messages(spark, d):
    r = view(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return r.select("conv_id", F.md5(P.reduce_message(F.lit("Sum it up"), F.col("parts"), F.when(F.col("conv_id") % 2 == 0, F.lit("code,2024-01\nA&B,1"))).cast("binary")).alias("digest"))


def b18_pick_messages(spark, d):
    r = _records(spark, d)
    path = F.when(F.col("pos") % 2 == 0, F.array(F.lit("Topic 1"))).otherwise(F.array().cast("array<string>"))
    return r.select("id", F.md5(P.pick_message(F.col("content"), path, F.array(F.lit("Theme 1"), F.lit("Theme 6"))).cast("binary")).alias("digest"))


def b19_code_judge_messages(spark, d):
    r = _records(spark, d)
    return r.select("id", F.md5(P.code_judge_message(F.col("content"), F.array(F.lit("Topic 1"), F.lit("Theme 6"))).cast("binary")).alias("digest"))


def b20_suffixes(spark, d):
    return _records(spark, d).select("id", T.language_suffix(F.when(F.col("pos") % 3 > 0, F.col("language")), "analysis").alias("suffix"))


def b21_languages(spark, d):
    x = view(spark, d, "events").select("event_id", F.concat(F.lit(" Old\t"), F.col("event_type"), F.lit("  (v."), F.col("event_id").cast("string"), F.lit(")'-{x}\n"), F.repeat(F.lit("ab "), (F.col("event_id") % 30).cast("int"))).alias("v"))
    return x.select("event_id", T.sanitize_language(F.col("v")).alias("language"))


def b22_resolved(spark, d):
    r = _records(spark, d).withColumn("asked", F.when(F.col("pos") % 4 == 0, F.concat(F.lit(" "), F.upper("language"))).when(F.col("pos") % 4 == 1, "French").when(F.col("pos") % 4 == 2, ""))
    return T.resolve_language(r, "asked").select("id", "language_code", "language_code_unsupported")


def b23_dots(spark, d):
    return view(spark, d, "events").select("event_id", T.quality_dots((F.col("event_id") % 101) / 100).alias("dots"))


def b24_pretty(spark, d):
    r = T.resolve_language(_records(spark, d), "language")
    score = F.when(F.col("pos") % 5 > 0, (F.col("pos") % 201) / 200)
    block = T.pretty_output(F.col("language_code"), id=F.col("id"), score=score, title=F.col("coding_level_1"), summary=F.col("coding_level_2"))
    return r.select("id", block.alias("pretty"))


def b25_detected(spark, d):
    return L.detect_language(_records(spark, d), "id", "content")


def b26_sentences(spark, d):
    return _records(spark, d).select("id", T.sentence_count(F.col("content")).cast("bigint").alias("n"))


def b27_scores(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 5 == 1, F.concat((F.col("event_id") % 130 / 100).cast("string"), F.lit("\nbecause"))).when(F.col("event_id") % 5 == 2, " -1 ").when(F.col("event_id") % 5 == 3, F.concat(F.lit(" 0."), (F.col("event_id") % 9).cast("string")))
    return view(spark, d, "events").select("event_id", T.parse_score(raw).alias("p")).select("event_id", "p.score", "p.reason")


def b28_selected(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('{"selected": ['), (e % 9).cast("string"), F.lit(", 2, 2, -1, 7.9, true, \"x\", null]}"))).when(e % 4 == 1, "oops").when(e % 4 == 2, '{"selected": []}').otherwise(F.concat(F.lit('{"selected": ["'), (e % 6).cast("string"), F.lit('", 1]}')))
    return view(spark, d, "events").select("event_id", F.array_join(T.parse_selected(raw, 8).cast("array<string>"), ",").alias("picked"))


def b29_structured(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.concat(F.lit('{"quality_score": '), (e % 15 / 10).cast("string"), F.lit(', "uncertainty_explanation": "why"}'))).when(e % 3 == 1, "{}").otherwise('{"quality_score": "high"')
    df = view(spark, d, "events").select("event_id", raw.alias("raw"))
    rules = {"score_range": F.coalesce(~F.col("parsed.quality_score").between(0, 1), F.lit(True))}
    return T.parse_structured(df, "raw", "struct<quality_score:double,uncertainty_explanation:string>", rules).select("event_id", F.col("parsed.quality_score").alias("score"), "parsed_error")


def b31_costs(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.lit(float("nan"))).when(e % 4 == 1, -F.col("value")).when(e % 4 == 2, F.col("value"))
    return view(spark, d, "events").select("event_id", T.coerce_cost(raw).alias("cost_usd"))


def b32_paths(spark, d):
    path = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(":"), "p_name")).otherwise(""), F.when(F.col("p_partkey") % 3 > 1, F.concat(F.lit(":"), "p_type")).otherwise(""))
    return view(spark, d, "part").select("p_partkey", T.parent_path(path).alias("parent"), T.leaf_short(path).alias("leaf"))


def _e(x: str) -> str:
    """SQL for escape_envelope."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_NL = "chr(10)"
_BLOCK = f"""'  <feedback_record id=' || CASE WHEN pos % 10 = 0 THEN '''' || id || '"''' ELSE '"' || id || '"' END || '>' || {_NL} || '    <text>' || {_e('content')} || '</text>' || {_NL}
  || CASE WHEN meta <> '' THEN '    <metadata>' || {_NL} || meta || {_NL} || '    </metadata>' || {_NL} ELSE '' END || '  </feedback_record>'"""
_BLOCKS = f"""m AS (SELECT *, concat_ws({_NL}, CASE WHEN created <> '' THEN '      created=' || created END, '      coding_level_1=' || coding_level_1, '      coding_level_2=' || coding_level_2, '      coding_level_3=' || coding_level_3) AS meta FROM records),
  blocks AS (SELECT *, {_BLOCK} AS block FROM m)"""
_BATCH = f"batch AS (SELECT corpus_id, count(*) AS n_records, '<feedback_records>' || {_NL} || string_agg(block, {_NL} ORDER BY pos) || {_NL} || '</feedback_records>' AS records FROM blocks GROUP BY 1)"
_PLAIN = f"'  <feedback_record>' || {_NL} || '    <text>' || {_e('content')} || '</text>' || {_NL} || '  </feedback_record>' || {_NL}"


def _n(text: str) -> str:
    """A Python text as SQL, its newlines spelled out."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


def _languages_sql() -> str:
    weights = ", ".join(f"('{lang}', '{gram}', {w})" for lang, gram, w in L.profiles())
    return f"""WITH p(lang, gram, w) AS (VALUES {weights}), t AS (SELECT id, ' ' || trim(regexp_replace(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ' AS t FROM records),
      c AS (SELECT id, string_split(t, '') AS c FROM t WHERE trim(t) <> ''), g AS (SELECT id, len(c) - 2 AS n, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c),
      s AS (SELECT id, lang, any_value(n) AS n, sum(w) AS s, count(*) AS hits FROM g JOIN p USING (gram) GROUP BY 1, 2), b AS (SELECT id, n, lang, hits FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, lang) = 1),
      d AS (SELECT r.id, CASE WHEN b.hits * 100 >= b.n * {L.LEAST_SHARE} THEN b.lang ELSE 'xx' END AS detected FROM records r LEFT JOIN b ON b.id = r.id)
      SELECT id, detected, CASE WHEN detected IN ({', '.join(f"'{x}'" for x in L.SUPPORTED)}) THEN detected ELSE 'xx' END AS language FROM d"""


_PICKED = "list_filter(list_transform(r, lambda x: CASE lower(x) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE TRY_CAST(x AS DOUBLE) END), lambda x: x IS NOT NULL)"
_HEAD = lambda kind: "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}:'" for k, v in T.HEADERS[kind].items()) + " END"
_DOTS = lambda x: "CASE " + " ".join(f"WHEN {x} >= {a} THEN '{b}'" for a, b in T.DOTS) + f" WHEN {x} IS NOT NULL THEN '○○○○○' END"

QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "b" and k[1].isdigit() and callable(f)}
SQL = {
    "b1_drop_empty": with_views(f"WITH {_ODD} SELECT corpus_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM odd WHERE content <> '' GROUP BY 1", "records"),
    "b2_empty_results": with_views(f"WITH {_ODD} SELECT id, false AS is_sensitive, '{V.NO_SENSITIVE_CONTENT}' AS explanation, CAST(0 AS INT) AS n_types FROM odd WHERE content = ''", "records"),
    "b3_quarantine": with_views(f"WITH {_ODD}, r AS (SELECT pos, concat_ws(',', CASE WHEN id = '' THEN 'id' END, CASE WHEN content = '' THEN 'content_empty' END, CASE WHEN length(content) > 100000 THEN 'content_long' END) AS failed_rules FROM odd) SELECT * FROM r WHERE failed_rules <> ''", "records"),
    "b4_bad_requests": """WITH r AS (SELECT event_id, concat_ws(',', CASE WHEN event_id % 50 * 100 NOT BETWEEN 1 AND 4000 THEN 'prompt' END, CASE WHEN event_id % 60 NOT BETWEEN 1 AND 50 THEN 'max_codes' END,
      CASE WHEN (event_id % 15) / 10 - 0.2 NOT BETWEEN 0 AND 1 THEN 'threshold' END, CASE WHEN event_id % 3 = 2 THEN 'mode' END, CASE WHEN event_id % 4 = 1 THEN 'period' END, CASE WHEN event_id % 7 < 1 THEN 'n_records' END) AS failed_rules FROM events) SELECT * FROM r WHERE failed_rules <> ''""",
    "b5_unknown_keys": with_views("SELECT id, 'colour' AS unknown_keys FROM records WHERE pos % 6 = 0", "records"),
    "b6_projected": with_views("SELECT id, created, coding_level_1, NULL::VARCHAR AS coding_level_2 FROM records", "records"),
    "b8_screened": with_views(f"WITH {_ODD} SELECT pos, CASE WHEN regexp_matches(content, '^\\s*(SYSTEM|ASSISTANT|USER)\\s*:', 'i') THEN 'role_prefix' WHEN contains(content, chr(0)) THEN 'null_byte' END AS injection FROM odd", "records"),
    "b9_token_estimates": with_views("SELECT id, CAST(length(content) // 4 AS BIGINT) AS estimated_tokens, length(content) // 4 > 1000 AS over_limit FROM records", "records"),
    "b10_clean": with_views("SELECT id, md5(replace(replace(content, chr(10), ' '), chr(13), '')) AS digest FROM records", "records"),
    "b11_escaped": f"SELECT page_id, md5({_e('html')}) AS digest FROM pages",
    "b12_record_envelopes": with_views(f"WITH {_BLOCKS} SELECT pos, md5(block) AS digest FROM blocks", "records"),
    "b13_batch_envelopes": with_views(f"WITH {_BLOCKS}, {_BATCH} SELECT corpus_id, n_records, md5(records) AS digest FROM batch", "records"),
    "b14_analyze_messages": with_views(f"WITH {_BLOCKS}, {_BATCH} SELECT corpus_id, md5('<analyst_instruction>' || {_NL} || 'What about &lt;' || corpus_id || '&gt;?' || {_NL} || '</analyst_instruction>' || {_NL} || {_NL} || records) AS digest FROM batch", "records"),
    "b16_judge_messages": with_views(f"SELECT id, md5('<source_text>' || {_NL} || content || {_n(chr(10) + '</source_text>' + chr(10) * 2 + '<analyst_prompt>' + chr(10) + 'Why {x} 100%?' + chr(10) + '</analyst_prompt>' + chr(10) * 2 + '<analysis_to_score>' + chr(10))} || language || {_NL} || '</analysis_to_score>') AS digest FROM records", "records"),
    "b17_reduce_messages": f"""WITH p AS (SELECT conv_id, string_agg('  <partial_analysis>' || {_e('text')} || '</partial_analysis>', {_NL} ORDER BY turn, text) AS b FROM conversations GROUP BY 1)
      SELECT conv_id, md5({_n('<analyst_instruction>' + chr(10) + 'Sum it up' + chr(10) + '</analyst_instruction>' + chr(10) * 2 + '<partial_analyses>' + chr(10))} || b || {_NL} || '</partial_analyses>' || CASE WHEN conv_id % 2 = 0 THEN {_n(chr(10) * 2 + '<coding_trends>' + chr(10) + 'code,2024-01' + chr(10) + 'A&amp;B,1' + chr(10) + '</coding_trends>')} ELSE '' END) AS digest FROM p""",
    "b18_pick_messages": with_views(f"""SELECT id, md5({_PLAIN} || CASE WHEN pos % 2 = 0 THEN {_n('<hierarchy_path>' + chr(10) + 'Code level 1: Topic 1' + chr(10) + '</hierarchy_path>' + chr(10) * 2)} ELSE '' END
      || {_n('<current_level>' + chr(10))} || 'Code level ' || CASE WHEN pos % 2 = 0 THEN '2' ELSE '1' END || {_n(chr(10) + '</current_level>' + chr(10) * 2 + '<options>' + chr(10) + '0: Theme 1' + chr(10) + '1: Theme 6' + chr(10) + '</options>')}) AS digest FROM records""", "records"),
    "b19_code_judge_messages": with_views(f"SELECT id, md5({_PLAIN} || {_n('<code_path>' + chr(10) + 'Code level 1: Topic 1' + chr(10) + 'Code level 2: Theme 6' + chr(10) + '</code_path>' + chr(10) * 2 + '<instruction>' + chr(10) + 'Score the assignment at code level 2.' + chr(10) + '</instruction>')}) AS digest FROM records", "records"),
    "b20_suffixes": with_views(f"SELECT id, CASE WHEN pos % 3 > 0 THEN {_n(chr(10) * 2 + 'Use this language for the analysis: ')} || language || '.' ELSE '' END AS suffix FROM records", "records"),
    "b21_languages": r"""WITH x AS (SELECT event_id, trim(regexp_replace(' Old' || chr(9) || event_type || '  (v.' || event_id || ')''-{x}' || chr(10) || repeat('ab ', CAST(event_id % 30 AS INT)), '\s+', ' ', 'g')) AS v FROM events),
      y AS (SELECT event_id, trim(regexp_replace(regexp_replace(v, '[^\p{L}\p{M} \-()'']', '', 'g'), ' +', ' ', 'g')) AS v FROM x) SELECT event_id, trim(substr(v, 1, 50)) AS language FROM y""",
    "b22_resolved": with_views("SELECT id, CASE WHEN pos % 4 = 1 THEN 'fr' WHEN pos % 4 = 0 AND language IN ('en', 'fr', 'es') THEN language ELSE 'en' END AS language_code, coalesce(pos % 4 = 0 AND language NOT IN ('en', 'fr', 'es'), false) AS language_code_unsupported FROM records", "records"),
    "b23_dots": f"WITH e AS (SELECT event_id, (event_id % 101) / 100 AS s FROM events) SELECT event_id, {_DOTS('s')} AS dots FROM e",
    "b24_pretty": with_views(f"""WITH p AS (SELECT *, CASE WHEN language IN ('en', 'fr', 'es') THEN language ELSE 'en' END AS code, CASE WHEN pos % 5 > 0 THEN (pos % 201) / 200 END AS s FROM records)
      SELECT id, concat_ws({_NL}, 'Feedback-ID:    ' || id, rpad({_HEAD('quality')}, 16, ' ') || {_DOTS('s')} || ' ' || CAST(round_even(s * 100, 0) AS INT) || '%', rpad({_HEAD('title')}, 16, ' ') || coding_level_1, {_HEAD('summary')} || {_NL} || coding_level_2, repeat('-', 60)) AS pretty FROM p""", "records"),
    "b25_detected": with_views(_languages_sql(), "records"),
    "b26_sentences": with_views(r"SELECT id, CASE WHEN trim(content) = '' THEN 0 ELSE greatest(len(list_filter(string_split_regex(trim(content), '[.!?]+\s+|\n'), lambda x: trim(x) <> '')), 1) END AS n FROM records", "records"),
    "b27_scores": """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(event_id % 130 / 100 AS VARCHAR) WHEN 2 THEN '-1' WHEN 3 THEN '0.' || event_id % 9 END AS t FROM events), n AS (SELECT event_id, t, TRY_CAST(t AS DOUBLE) AS n FROM e)
      SELECT event_id, CASE WHEN n BETWEEN 0 AND 1 THEN n END AS score, CASE WHEN t IS NULL THEN 'missing' WHEN n IS NULL THEN 'not a number' WHEN n NOT BETWEEN 0 AND 1 THEN 'out of range' END AS reason FROM n""",
    "b28_selected": f"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN [CAST(event_id % 9 AS VARCHAR), '2', '2', '-1', '7.9', 'true', 'x', NULL] WHEN 3 THEN [CAST(event_id % 6 AS VARCHAR), '1'] ELSE [] END AS r FROM events),
      f AS (SELECT event_id, list_filter(list_transform({_PICKED}, lambda x: CAST(trunc(x) AS INT)), lambda x: x >= 0 AND x < 8) AS l FROM e)
      SELECT event_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ',') AS picked FROM f""",
    "b29_structured": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 15 <= 10 THEN event_id % 15 / 10 END AS score, CASE WHEN event_id % 3 > 0 THEN 'unreadable' WHEN event_id % 15 > 10 THEN 'score_range' END AS parsed_error FROM events",
    "b31_costs": "SELECT event_id, CASE WHEN event_id % 4 = 2 AND value >= 0 THEN CAST(value AS DECIMAL(12,6)) WHEN event_id % 4 = 1 AND -value >= 0 THEN CAST(-value AS DECIMAL(12,6)) ELSE CAST(0 AS DECIMAL(12,6)) END AS cost_usd FROM events",
    "b32_paths": """WITH p AS (SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 > 0 THEN ':' || p_name ELSE '' END || CASE WHEN p_partkey % 3 > 1 THEN ':' || p_type ELSE '' END AS p FROM part)
      SELECT p_partkey, CASE WHEN contains(p, ':') THEN regexp_replace(p, ':[^:]*$', '') ELSE p END AS parent, string_split(p, ':')[-1] AS leaf FROM p""",
}
