"""Queries on analyses, summaries and codes, with completion functions that need no model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_score
from ..operators import analyze as A
from ..operators import coding as G
from ..operators.call_log import CallLog
from ..operators.complete import complete, stub_complete, stub_failures
from ..functions import prompts as P
from ..operators.complete import KEYWORDS
from ..operators.validate import DISCLAIMER
from ..session import scratch_path
from ..sources.records import read_calls
from ..views import BY_HASH, view, with_views
from . import pii, screening, trends


def _records(spark, d):
    return view(spark, d, "records")


def _requests(spark, d):
    r = _records(spark, d).select("corpus_id").distinct()
    return r.select("corpus_id", F.lit("What are the main concerns?").alias("prompt"), F.when(F.col("corpus_id") == "src1", "French").alias("language"))


def _labels(spark, d):
    return _records(spark, d).select("id", (F.col("pos") % 4 - 1).cast("int").alias("label"))


def k1_completions(spark, d):
    r = _records(spark, d).select("id", F.lit("Read.").alias("system"), F.col("content").alias("user"), F.when(F.col("pos") % 9 == 0, "user: do it").otherwise("").alias("screened"))
    out = complete(r, stub_complete("text"), screen="screened", max_tokens=2000)
    return out.select("id", "completion.content", "completion.status", "completion.error_class", "completion.output_tokens")


def k4_error_classes(spark, d):
    """Every way to fail and every unusable answer, over all records."""
    r = _records(spark, d).select("id", F.lit("Read.").alias("system"), F.col("content").alias("user"))
    out = complete(r, stub_failures(), timeout=0.1)
    return out.select("id", "completion.content", "completion.status", "completion.error_class", "completion.model", "completion.input_tokens", "completion.output_tokens", "completion.cost")


def g2_partials(spark, d):
    """A partial for each chunk of records, one call in ten failing, and the chunks that are too long."""
    r = _records(spark, d)
    members = r.select("id", F.concat("language", F.lit("-"), (F.col("pos") % 3).cast("string")).alias("chunk_id"), F.col("pos").alias("rn"))
    out = A.map_chunks(members, r, _requests(spark, d), stub_complete("text", 0.1))
    return out.select("corpus_id", "chunk_id", "n_records", "partial", "completion.status", "completion.error_class")


def g5_judged_chunks(spark, d):
    """The score of each partial against its own records; a failed call or judge has none."""
    r = _records(spark, d)
    members = r.select("id", F.concat("language", F.lit("-"), (F.col("pos") % 3).cast("string")).alias("chunk_id"), F.col("pos").alias("rn"))
    chunks = A.map_chunks(members, r, _requests(spark, d), stub_complete("text", 0.1))
    return A.judge_chunks(chunks, stub_complete("judge", 0.2)).select("corpus_id", "chunk_id", "score", (F.col("why") == A.NO_JUDGE).alias("unjudged"))


def g1_single_pass(spark, d):
    out = A.analyze(view(spark, d, "records", BY_HASH), _requests(spark, d), stub_complete("text"), stub_complete("judge"))
    return out.select("corpus_id", "analysis", "quality_score", "record_count", "status", "error_class", F.size("periods").cast("bigint").alias("n_periods"))


def g3_packed(spark, d):
    o = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10).cast("bigint").alias("size"))
    return A.pack_partials(o, "l_orderkey", "size", "l_linenumber", 400).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("group").cast("bigint").alias("group"))


def g4_tree(spark, d):
    p = _records(spark, d).select("corpus_id", F.col("pos").alias("ord"), F.when(F.col("pos") % 11 > 0, F.col("content")).alias("partial"))
    return A.tree_reduce(p, _requests(spark, d), stub_complete("text"), budget=20_000).withColumn("rounds", F.col("rounds").cast("bigint"))


def g6_confidence(spark, d):
    o = view(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 101) / 100).alias("score"), (F.col("o_orderkey") % 7).alias("n_records"))
    return A.confidence(o, ["o_custkey"]).select("o_custkey", F.round("confidence", 6).alias("confidence"), "judged", "chunks", "lowest")


def g7_uncertainty(spark, d):
    return A.uncertainty_text(g6_confidence(spark, d)).select("o_custkey", "uncertainty")


def g8_hierarchical(spark, d):
    out = A.analyze_hierarchical(_records(spark, d), _requests(spark, d), _labels(spark, d), stub_complete("text", 0.1), stub_complete("judge", 0.1), budget=20_000)
    return out.select("corpus_id", "analysis", "status", F.round("confidence", 6).alias("confidence"), "uncertainty", "chunks", "judged")


def g10_summaries(spark, d):
    return A.summarize(_records(spark, d), stub_complete("summary"))


def g11_bulk_summaries(spark, d):
    return A.summarize_bulk(_records(spark, d), stub_complete("summary")).select("corpus_id", "title", "summary", "quality_score", F.size("ids").cast("bigint").alias("n_ids"))


def h14_analysis_log(spark, d):
    """The log that summaries and screens of all records leave, one call in ten failing."""
    r, path = _records(spark, d), scratch_path(spark, "log")
    who = r.select("id", F.concat(F.lit("tenant_"), (F.col("pos") % 7).cast("string")).alias("tenant_id"), F.concat(F.lit("call-"), "corpus_id").alias("call_id"))
    A.summarize(r, stub_complete("summary", 0.1), log=CallLog(path, "summarize", who, "id"))
    A.detect_sensitive(r, stub_complete("sensitive", 0.1), log=CallLog(path, "detect_sensitive", who.where("tenant_id <> 'tenant_3'"), "id"))
    return read_calls(spark, path).select("tenant_id", "operation", "call_id", "model", "input_tokens", "output_tokens", "cost_usd", "status", "error_class")


def g12_quality_score(spark, d):
    e = F.col("event_id")
    return view(spark, d, "events").select("event_id", F.round(A.quality_score(e % 11 / 10, e % 7 / 10, e % 3 / 10), 6).alias("score"))


def g13_sensitive(spark, d):
    return A.detect_sensitive(_records(spark, d), stub_complete("sensitive")).select("id", "is_sensitive", F.array_join("sensitivity_types", ",").alias("types"), "error_class")


def g14_codes(spark, d):
    out = G.assign_codes(view(spark, d, "records", BY_HASH), view(spark, d, "framework"), stub_complete("pick"), stub_complete("score"), max_codes=3, threshold=0.2)
    return out.drop("explanation").withColumn("rank", F.col("rank").cast("bigint"))


def g15_threshold(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, "?").otherwise(((F.col("event_id") % 13) / 10).cast("string"))
    s = view(spark, d, "events").select("event_id", parse_score(raw)["score"].alias("score"))
    return s.where("score is not null and score >= 0.5")


def _paths(spark, d):
    e = F.col("event_id")
    s = F.array(*[F.round(((e * (k + 3)) % 101) / 100, 2) for k in range(3)])
    return view(spark, d, "events").select("event_id", "user_id", s.alias("scores"), F.array(F.lit("a"), F.col("event_type"), F.lit("c")).alias("whys"), F.array(F.lit("p"), F.lit("q")).alias("path"), F.array(F.lit("P"), F.lit("Q")).alias("names"))


def g16_path_scores(spark, d):
    return G.score_paths(_paths(spark, d)).select("event_id", "confidence", "explanation")


def g17_top_codes(spark, d):
    return G.top_codes(G.score_paths(_paths(spark, d)), "user_id", 3, seq="event_id").select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"), "confidence")


def g18_path_columns(spark, d):
    return G.path_columns(_paths(spark, d)).select("event_id", "code_1_id", "code_2_name", "code_3_id", "code_3_confidence")


def g19_paths(spark, d):
    p = G.framework_paths(view(spark, d, "framework"))
    return p.select("node_id", F.array_join("names", " > ").alias("path"), F.col("depth").cast("bigint").alias("depth"), "is_leaf", F.col("min_leaf_depth").cast("bigint").alias("min_leaf_depth"), F.col("max_leaf_depth").cast("bigint").alias("max_leaf_depth"))


def _lines(spark, d):
    """Customers as codes: chains of a hundred levels, with a cycle and a parent that is not there further down."""
    k = F.col("c_custkey") % 150
    parent = F.when(k == 100, F.col("c_custkey") + 2).when(k == 120, -F.col("c_custkey")).when(k > 0, F.col("c_custkey") - 1)
    return view(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), parent.alias("parent_id"), F.col("c_name").alias("name"), k.alias("position"))


def g19_depths(spark, d):
    p = G.framework_paths(_lines(spark, d))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return p.select("node_id", F.md5(F.array_join("names", ">").cast("binary")).alias("path_md5"), long("depth"), "is_leaf", long("min_leaf_depth"), long("max_leaf_depth"), "error")


def g20_nested(spark, d):
    p = view(spark, d, "part")
    l1 = p.select(F.col("p_size").cast("string").alias("id"), F.concat(F.lit("size "), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("name"), F.lit(None).cast("string").alias("parent_id")).distinct()
    l2 = p.select(F.concat_ws("|", F.col("p_size").cast("string"), "p_brand").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("name"), F.col("p_size").cast("string").alias("parent_id")).distinct()
    l3 = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws("|", F.col("p_size").cast("string"), "p_brand").alias("parent_id"))
    text = lambda kids: F.array_join(F.transform(kids, lambda c: F.concat(c["name"], F.lit("("), F.array_join(F.transform(c["children"], lambda x: x["id"]), ","), F.lit(")"))), ";")
    return G.nest_framework(l1, l2, l3).select("id", "name", text(F.col("children")).alias("children"))


# ---------------------------------------------------------------- SQL of what the completion functions without a model answer

_n, _e = screening._n, screening._e
_TAG = lambda x: f"substr(md5({x}), 1, 12)"
_UNIT = lambda x: f"(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) / 4294967296.0)"
_ASK = "What are the main concerns?"
_HEAD = f"<analyst_instruction>\n{_ASK}\n</analyst_instruction>\n\n"
_SUFFIX = "CASE WHEN corpus_id = 'src1' THEN " + _n("\n\nUse this language for the analysis: French.") + " ELSE '' END"
_LONG = lambda system, user: f"(length({system}) + length({user})) // 4 > 100000"
_OWN_BLOCK = "'  <feedback_record id=\"' || id || '\">' || chr(10) || '    <text>' || " + _e("content") + " || '</text>' || chr(10)"
_META_BLOCK = _OWN_BLOCK + " || CASE WHEN meta <> '' THEN '    <metadata>' || chr(10) || meta || chr(10) || '    </metadata>' || chr(10) ELSE '' END || '  </feedback_record>'"


def _batches(records: str) -> str:
    return screening._BLOCKS.replace(screening._BLOCK, _META_BLOCK).replace("FROM records", f"FROM {records}").replace("m AS (", "meta_lines AS (").replace("FROM m)", "FROM meta_lines)") + ", " + screening._BATCH


_G1 = f"""{pii._BASE}, {pii._replaced("placeholder")}, red AS (SELECT r.* REPLACE (o.content AS content) FROM records r JOIN out o ON o.id = r.id), {_batches("red")}, {trends._PERIODS},
  u AS (SELECT corpus_id, n_records, records, {_n(_HEAD)} || records AS u, {_n(P.SYSTEM["analyze"])} || {_SUFFIX} AS s FROM batch),
  a AS (SELECT *, {_LONG("s", "u")} AS large, 'analysis ' || {_TAG("u")} AS answer FROM u),
  j AS (SELECT *, '<source_text>' || chr(10) || records || {_n(chr(10) + "</source_text>" + chr(10) * 2 + "<analyst_prompt>" + chr(10) + _ASK + chr(10) + "</analyst_prompt>" + chr(10) * 2 + "<analysis_to_score>" + chr(10))} || answer || {_n(chr(10) + "</analysis_to_score>")} AS ju FROM a)
  SELECT corpus_id, CASE WHEN NOT large THEN {_n(DISCLAIMER)} || answer END AS analysis, CASE WHEN NOT large AND NOT {_LONG(_n(P.SYSTEM["judge"]), "ju")} THEN round({_UNIT("ju")}, 2) END AS quality_score,
    n_records AS record_count, CASE WHEN large THEN 'error' ELSE 'ok' END AS status, CASE WHEN large THEN 'DocumentsTooLargeError' END AS error_class, (SELECT count(*) FROM periods p WHERE p.corpus_id = j.corpus_id) AS n_periods FROM j"""
_SUMMARY = lambda keep, frm, system: f"""SELECT {keep}, CASE WHEN NOT large THEN 'Title ' || substr(md5(u), 1, 4) END AS title, CASE WHEN NOT large THEN 'Summary ' || {_TAG("u")} END AS summary,
    CASE WHEN NOT large THEN round({_UNIT("u")}, 2) END AS quality_score FROM (SELECT *, {_LONG(_n(P.SYSTEM[system]), "u")} AS large FROM {frm})"""  # noqa: E731
_G10 = f"""WITH b AS (SELECT id, {_OWN_BLOCK} || '  </feedback_record>' AS u FROM records WHERE content <> ''), g AS ({_SUMMARY("id, CASE WHEN large THEN 'DocumentsTooLargeError' END AS error_class", "b", "summarize")})
  SELECT * FROM g UNION ALL BY NAME SELECT id, '' AS title, '' AS summary, 0.0 AS quality_score, NULL AS error_class FROM records WHERE coalesce(content, '') = ''"""
_G11 = f"WITH {_batches('records')}, b AS (SELECT corpus_id, n_records AS n_ids, records AS u FROM batch) {_SUMMARY('corpus_id, n_ids', 'b', 'aggregate')}"
_CHUNKED = f"""{_batches("(SELECT * REPLACE (corpus_id || '|' || language || '-' || pos % 3 AS corpus_id) FROM records)")}, u AS (SELECT split_part(corpus_id, '|', 1) AS corpus_id, split_part(corpus_id, '|', 2) AS chunk_id, n_records, records, {_n(_HEAD)} || records AS u FROM batch),
  a AS (SELECT *, {_LONG(_n(P.SYSTEM["map"]), "u")} AS large, {_UNIT("u")} AS x FROM u),
  m AS (SELECT corpus_id, chunk_id, n_records, records, CASE WHEN NOT large AND x >= 0.1 THEN 'analysis ' || {_TAG("u")} END AS partial, CASE WHEN large THEN 'DocumentsTooLargeError' WHEN x < 0.05 THEN 'LLMContentPolicyError' WHEN x < 0.1 THEN 'LLMBadRequestError' END AS error_class FROM a)"""
_G2 = f"WITH {_CHUNKED} SELECT corpus_id, chunk_id, n_records, partial, CASE WHEN error_class IS NULL THEN 'ok' ELSE 'error' END AS status, error_class FROM m"
_G5 = f"""WITH {_CHUNKED}, j AS (SELECT *, '<source_text>' || chr(10) || records || {_n(chr(10) + "</source_text>" + chr(10) * 2 + "<analyst_prompt>" + chr(10) + _ASK + chr(10) + "</analyst_prompt>" + chr(10) * 2 + "<analysis_to_score>" + chr(10))} || partial || {_n(chr(10) + "</analysis_to_score>")} AS ju FROM m),
  k AS (SELECT *, partial IS NOT NULL AND {_UNIT("ju")} >= 0.2 AND NOT {_LONG(_n(P.SYSTEM["judge"]), "ju")} AS good FROM j) SELECT corpus_id, chunk_id, CASE WHEN good THEN round({_UNIT("ju")}, 2) END AS score, NOT good AS unjudged FROM k"""
_K4 = f"""WITH r AS (SELECT id, CAST(floor({_UNIT("content")} * 10) AS INT) AS k, (length(content) + 5) // 4 > 100000 AS large FROM records)
  SELECT id, CASE WHEN NOT large AND k = 9 THEN 'right' END AS content, CASE WHEN NOT large AND k = 9 THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN large THEN 'DocumentsTooLargeError' WHEN k < 9 THEN ['LLMTimeoutError', 'LLMRateLimitError', 'LLMContentPolicyError', 'LLMBadRequestError', 'LLMError', 'LLMResponseError', 'LLMResponseError', 'LLMResponseError', 'LLMResponseError'][k + 1] END AS error_class,
    CASE WHEN NOT large AND k = 9 THEN 'stub' ELSE '' END AS model, CASE WHEN NOT large AND k = 9 THEN 3 ELSE 0 END AS input_tokens, CASE WHEN NOT large AND k = 9 THEN 2 ELSE 0 END AS output_tokens, 0e0 AS cost FROM r"""
_KINDS = ", ".join("CASE WHEN " + " OR ".join(f"contains(l, '{k}')" for k in keys) + f" THEN '{t}' END" for t, keys in KEYWORDS.items())
_G13 = f"""WITH b AS (SELECT id, content, {screening._PLAIN} AS v FROM records), l AS (SELECT id, coalesce(content, '') <> '' AS filled, {_LONG(_n(P.SYSTEM["sensitivity"]), "v[:-2]")} AS large, lower(v) AS l FROM b),
  t AS (SELECT *, CASE WHEN NOT filled THEN '' WHEN NOT large THEN concat_ws(',', {_KINDS}) END AS types FROM l)
  SELECT id, types <> '' AS is_sensitive, types, CASE WHEN filled AND large THEN 'DocumentsTooLargeError' END AS error_class FROM t"""

_CALLED = lambda operation, system, answer, frm: f"""SELECT id, pos, '{operation}' AS operation, {_UNIT("u")} AS x, ({len(P.SYSTEM[system])} + length(u)) // 4 AS sent, length({answer}) // 4 AS got FROM {frm} WHERE NOT {_LONG(_n(P.SYSTEM[system]), "u")}"""
_ROUNDED = f"""'{{"title": "Title abcd", "summary": "Summary abcdefabcdef", "quality_score": ' || CAST(round({_UNIT("u")}, 2) AS VARCHAR) || '}}'"""
_LOG = f"""WITH b AS (SELECT id, pos, {_OWN_BLOCK} || '  </feedback_record>' AS u FROM records WHERE content <> ''), v AS (SELECT id, pos, {screening._PLAIN} AS v FROM records WHERE content <> ''),
  k AS (SELECT id, pos, v[:-2] AS u, lower(v) AS l FROM v), t AS (SELECT id, pos, u, list_filter([{_KINDS}], lambda x: x IS NOT NULL) AS t FROM k),
  c AS ({_CALLED("summarize", "summarize", _ROUNDED, "b")} UNION ALL {_CALLED("detect_sensitive", "sensitivity", """'{"sensitivity_types": [' || array_to_string(list_transform(t, lambda x: '"' || x || '"'), ', ') || '], "explanation": "' || array_to_string(t, ', ') || '"}'""", "t")})
  SELECT CASE WHEN known THEN 'tenant_' || c.pos % 7 END AS tenant_id, operation, CASE WHEN known THEN 'call-' || corpus_id END AS call_id, CASE WHEN x < 0.1 THEN '' ELSE 'stub' END AS model, CASE WHEN x < 0.1 THEN 0 ELSE sent END AS input_tokens, CASE WHEN x < 0.1 THEN 0 ELSE got END AS output_tokens,
    CAST(0 AS DECIMAL(12,6)) AS cost_usd, CASE WHEN x < 0.1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN x < 0.05 THEN 'LLMContentPolicyError' WHEN x < 0.1 THEN 'LLMBadRequestError' END AS error_class
  FROM (SELECT *, operation = 'summarize' OR pos % 7 <> 3 AS known FROM c) c JOIN records r ON r.id = c.id"""


def _tree_sql(budget: int, rounds: int) -> str:
    """tree_reduce round by round, as far as the given tables need."""
    empty = len(_HEAD + "<partial_analyses>\n" + "\n</partial_analyses>") - 1
    parts = [f"""q AS (SELECT DISTINCT corpus_id, {budget * 4 + 3 - empty - len(P.SYSTEM["reduce"])} - length({_SUFFIX}) AS room FROM records),
      p1 AS (SELECT corpus_id, pos AS ord, content AS partial FROM records WHERE pos % 11 > 0 AND content IS NOT NULL)"""]
    for r in range(1, rounds + 1):
        parts.append(f"""s{r} AS MATERIALIZED (SELECT p.corpus_id, ord, partial, room, length({_e("partial")}) + {len("  <partial_analysis></partial_analysis>") + 1} AS size, row_number() OVER w AS i, count(*) OVER (PARTITION BY p.corpus_id) AS n FROM p{r} p JOIN q ON q.corpus_id = p.corpus_id WINDOW w AS (PARTITION BY p.corpus_id ORDER BY ord)),
      f{r} AS (SELECT corpus_id, i, n, room, size AS used, CAST(0 AS BIGINT) AS g FROM s{r} WHERE i = 1 UNION ALL
        SELECT s.corpus_id, s.i, s.n, s.room, CASE WHEN f.used + s.size <= s.room THEN f.used + s.size ELSE s.size END, CASE WHEN f.used + s.size <= s.room THEN f.g ELSE f.g + 1 END FROM f{r} f JOIN s{r} s ON s.corpus_id = f.corpus_id AND s.i = f.i + 1),
      h{r} AS (SELECT corpus_id, i, CASE WHEN n > 1 AND max(g) OVER (PARTITION BY corpus_id) = 0 THEN CASE WHEN i - 1 < n // 2 THEN 0 ELSE 1 END ELSE g END AS g FROM f{r}),
      l{r} AS (SELECT s.corpus_id, max(n) <= 1 OR sum(size) <= any_value(room) OR count(DISTINCT g) = max(n) AS last FROM s{r} s JOIN h{r} h ON h.corpus_id = s.corpus_id AND h.i = s.i GROUP BY 1),
      m{r} AS (SELECT s.corpus_id, last, CASE WHEN last THEN 0 ELSE g END AS g, sum(size) > any_value(room) AS large, {_n(_HEAD + "<partial_analyses>" + chr(10))} || string_agg('  <partial_analysis>' || {_e("partial")} || '</partial_analysis>', chr(10) ORDER BY s.i) || {_n(chr(10) + "</partial_analyses>")} AS u
        FROM s{r} s JOIN h{r} h ON h.corpus_id = s.corpus_id AND h.i = s.i JOIN l{r} l ON l.corpus_id = s.corpus_id GROUP BY ALL),
      d{r} AS (SELECT corpus_id, CASE WHEN NOT large THEN 'analysis ' || {_TAG("u")} END AS analysis, CASE WHEN large THEN 'DocumentsTooLargeError' END AS error_class, {r} AS rounds FROM m{r} WHERE last
        UNION ALL SELECT DISTINCT corpus_id, NULL, 'DocumentsTooLargeError', {r} FROM m{r} WHERE NOT last AND large),
      p{r + 1} AS (SELECT corpus_id, g AS ord, 'analysis ' || {_TAG("u")} AS partial FROM m{r} WHERE corpus_id NOT IN (SELECT corpus_id FROM d{r}))""")
    ends = " UNION ALL ".join(f"SELECT * FROM d{r}" for r in range(1, rounds + 1))
    parts.append(f"ends AS ({ends} UNION ALL SELECT corpus_id, NULL, 'AnalysisError', 0 FROM q WHERE corpus_id NOT IN (SELECT corpus_id FROM p1))")
    return "WITH RECURSIVE " + ",\n".join(parts) + " SELECT corpus_id, analysis, CASE WHEN error_class IS NULL THEN 'ok' ELSE 'error' END AS status, error_class, CAST(rounds AS BIGINT) AS rounds FROM ends"


def _codes_sql(levels: int, max_codes: int, threshold: float) -> str:
    """assign_codes level by level; the framework of the given tables has so many."""
    plain = screening._PLAIN
    lines = "array_to_string(list_transform(names, lambda x, i: 'Code level ' || i || ': ' || x), chr(10))"
    empty = lambda t: f"CAST([] AS {t}[])"
    parts = [f"""o AS (SELECT coalesce(parent_id, '') AS spot, list(node_id ORDER BY position, node_id) AS ids, list(name ORDER BY position, node_id) AS labels FROM framework GROUP BY 1),
      t0 AS (SELECT id, '' AS spot, {empty("VARCHAR")} AS path, {empty("VARCHAR")} AS names, {empty("DOUBLE")} AS scores, {empty("BIGINT")} AS seq FROM records WHERE content <> '')"""]
    for k in range(levels):
        parts.append(f"""a{k} AS (SELECT t.*, content, ids, labels, {plain} || CASE WHEN len(names) > 0 THEN '<hierarchy_path>' || chr(10) || {lines} || {_n(chr(10) + "</hierarchy_path>" + chr(10) * 2)} ELSE '' END
        || '<current_level>' || chr(10) || 'Code level ' || (len(names) + 1) || {_n(chr(10) + "</current_level>" + chr(10) * 2 + "<options>" + chr(10))} || array_to_string(list_transform(labels, lambda x, i: (i - 1) || ': ' || x), chr(10)) || chr(10) || '</options>' AS u
        FROM t{k} t JOIN o ON o.spot = t.spot JOIN records r ON r.id = t.id),
      c{k} AS (SELECT *, unnest(list_sort(list_distinct([CAST(floor({_UNIT("u")} * len(labels)) AS BIGINT), CAST(floor({_UNIT("u")} * 7919) AS BIGINT) % len(labels)]))) AS pick FROM a{k}),
      n{k} AS (SELECT id, content, list_append(path, ids[pick + 1]) AS path, list_append(names, labels[pick + 1]) AS names, scores, list_append(seq, pick) AS seq FROM c{k}),
      j{k} AS (SELECT *, {plain} || '<code_path>' || chr(10) || {lines} || {_n(chr(10) + "</code_path>" + chr(10) * 2 + "<instruction>" + chr(10) + "Score the assignment at code level ")} || len(names) || '.' || chr(10) || '</instruction>' AS ju FROM n{k}),
      t{k + 1} AS (SELECT id, path[-1] AS spot, path, names, list_append(scores, s) AS scores, seq FROM (SELECT *, round({_UNIT("ju")}, 2) AS s FROM j{k}) WHERE s >= {threshold})""")
    leaves = " UNION ALL ".join(f"SELECT * FROM t{k} WHERE spot NOT IN (SELECT spot FROM o)" for k in range(1, levels + 1))
    cols = ", ".join(f"path[{k}] AS code_{k}_id, names[{k}] AS code_{k}_name, scores[{k}] AS code_{k}_confidence" for k in (1, 2, 3))
    parts.append(f"f AS (SELECT *, list_min(scores) AS confidence FROM ({leaves})), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, seq) AS rank FROM f)")
    return "WITH " + ",\n".join(parts) + f" SELECT id, rank, {cols}, confidence, CAST(NULL AS VARCHAR) AS error_class FROM best WHERE rank <= {max_codes}"


_EV = "CAST(round(((event_id * {k}) % 101) / 100, 2) AS DOUBLE)"
_S = [_EV.format(k=k) for k in (3, 4, 5)]
_P = f"p AS (SELECT event_id, user_id, event_type, [{', '.join(_S)}] AS s FROM events)"
QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "ghk" and k[1].isdigit() and callable(f)}
SQL = {
    "k1_completions": with_views("""WITH r AS (SELECT id, CASE WHEN pos % 9 = 0 THEN 'AnalysisError' WHEN (length(content) + 5) // 4 > 2000 THEN 'DocumentsTooLargeError' END AS e, 'analysis ' || substr(md5(content), 1, 12) AS c FROM records)
      SELECT id, CASE WHEN e IS NULL THEN c END AS content, CASE WHEN e IS NULL THEN 'ok' ELSE 'error' END AS status, e AS error_class, CASE WHEN e IS NULL THEN CAST(length(c) // 4 AS BIGINT) ELSE 0 END AS output_tokens FROM r""", "records"),
    "g1_single_pass": with_views(_G1, "records"),
    "g4_tree": with_views(_tree_sql(20_000, 4), "records"),
    "g2_partials": with_views(_G2, "records"),
    "g5_judged_chunks": with_views(_G5, "records"),
    "k4_error_classes": with_views(_K4, "records"),
    "h14_analysis_log": with_views(_LOG, "records"),
    "g10_summaries": with_views(_G10, "records"),
    "g11_bulk_summaries": with_views(_G11, "records"),
    "g13_sensitive": with_views(_G13, "records"),
    "g14_codes": with_views(_codes_sql(3, 3, 0.2), "records", "framework"),
    "g3_packed": """WITH RECURSIVE s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 10 AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity * 10 AS BIGINT)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
      f AS (SELECT l_orderkey, l_linenumber, i, n, size AS used, CAST(0 AS BIGINT) AS g FROM s WHERE i = 1 UNION ALL
        SELECT s.l_orderkey, s.l_linenumber, s.i, s.n, CASE WHEN f.used + s.size <= 400 THEN f.used + s.size ELSE s.size END, CASE WHEN f.used + s.size <= 400 THEN f.g ELSE f.g + 1 END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.i = f.i + 1)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN n > 1 AND max(g) OVER (PARTITION BY l_orderkey) = 0 THEN CASE WHEN i - 1 < n // 2 THEN 0 ELSE 1 END ELSE g END AS "group" FROM f""",
    "g6_confidence": """WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 101) / 100 END AS score, o_orderkey % 7 AS w FROM orders)
      SELECT o_custkey, round(CASE WHEN count(score) = 0 THEN NULL WHEN sum(w) FILTER (WHERE score IS NOT NULL) = 0 THEN 0.0 ELSE sum(score * w) / sum(w) FILTER (WHERE score IS NOT NULL) END, 6) AS confidence, count(score) AS judged, count(*) AS chunks, min(score) AS lowest FROM o GROUP BY 1""",
    "g7_uncertainty": """WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 101) / 100 END AS score FROM orders), c AS (SELECT o_custkey, count(score) AS j, count(*) AS n, min(score) AS l FROM o GROUP BY 1)
      SELECT o_custkey, CASE WHEN j = 0 THEN 'No confidence: none of the ' || n || ' chunk(s) could be judged.' ELSE 'The confidence is a mean over ' || j || ' of ' || n || ' chunk(s), weighted by records' || CASE WHEN n > j THEN ' (' || (n - j) || ' left out, as their judges failed)' ELSE '' END || '; the lowest score of a chunk is ' || printf('%.2f', l) || '.' END AS uncertainty FROM c""",
    "g12_quality_score": "SELECT event_id, round(0.6 * (event_id % 11 / 10) + 0.3 * (event_id % 7 / 10) + 0.1 * (event_id % 3 / 10), 6) AS score FROM events",
    "g15_threshold": "SELECT event_id, (event_id % 13) / 10 AS score FROM events WHERE event_id % 9 > 0 AND (event_id % 13) / 10 BETWEEN 0.5 AND 1",
    "g16_path_scores": f"WITH {_P} SELECT event_id, list_min(s) AS confidence, printf('Level 1 (%.2f): a Level 2 (%.2f): ', s[1], s[2]) || event_type || printf(' Level 3 (%.2f): c', s[3]) AS explanation FROM p",
    "g17_top_codes": f"WITH {_P} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY list_min(s) DESC, event_id) AS rank, list_min(s) AS confidence FROM p QUALIFY rank <= 3",
    "g18_path_columns": f"WITH {_P} SELECT event_id, 'p' AS code_1_id, 'Q' AS code_2_name, NULL::VARCHAR AS code_3_id, s[3] AS code_3_confidence FROM p",
    "g19_paths": with_views("""WITH RECURSIVE t AS (SELECT node_id, [node_id] AS ids, name AS path, 1 AS depth FROM framework WHERE parent_id IS NULL UNION ALL SELECT f.node_id, list_append(t.ids, f.node_id), t.path || ' > ' || f.name, t.depth + 1 FROM framework f JOIN t ON f.parent_id = t.node_id),
      l AS (SELECT *, node_id NOT IN (SELECT parent_id FROM framework WHERE parent_id IS NOT NULL) AS is_leaf FROM t), b AS (SELECT unnest(ids) AS node_id, depth AS d FROM l WHERE is_leaf)
      SELECT l.node_id, path, CAST(depth AS BIGINT) AS depth, is_leaf, CAST(min(d) AS BIGINT) AS min_leaf_depth, CAST(max(d) AS BIGINT) AS max_leaf_depth FROM l JOIN b ON b.node_id = l.node_id GROUP BY 1, 2, 3, 4""", "framework"),
    "g19_depths": """WITH RECURSIVE n AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 150 = 100 THEN c_custkey + 2 WHEN c_custkey % 150 = 120 THEN -c_custkey WHEN c_custkey % 150 > 0 THEN c_custkey - 1 END AS parent_id, c_name AS name FROM customer),
      t AS (SELECT node_id, [node_id] AS ids, name AS path, 1 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, list_append(t.ids, n.node_id), t.path || '>' || n.name, t.depth + 1 FROM n JOIN t ON n.parent_id = t.node_id),
      o AS (SELECT node_id FROM n WHERE parent_id NOT IN (SELECT node_id FROM n) UNION ALL SELECT n.node_id FROM n JOIN o ON n.parent_id = o.node_id),
      inner_ AS (SELECT DISTINCT parent_id AS node_id FROM n WHERE parent_id IS NOT NULL), b AS (SELECT unnest(ids) AS node_id, depth AS d FROM t WHERE node_id NOT IN (SELECT node_id FROM inner_)),
      m AS (SELECT node_id, min(d) AS lo, max(d) AS hi FROM b GROUP BY 1)
      SELECT n.node_id, md5(t.path) AS path_md5, CAST(t.depth AS BIGINT) AS depth, n.node_id NOT IN (SELECT node_id FROM inner_) AS is_leaf, CAST(lo AS BIGINT) AS min_leaf_depth, CAST(hi AS BIGINT) AS max_leaf_depth,
        CASE WHEN t.node_id IS NOT NULL THEN NULL WHEN n.node_id IN (SELECT node_id FROM o) THEN 'unknown parent' ELSE 'cycle' END AS error
      FROM n LEFT JOIN t ON t.node_id = n.node_id LEFT JOIN m ON m.node_id = n.node_id""",
    "g20_nested": """WITH p AS (SELECT CAST(p_size AS VARCHAR) AS s, CAST(p_size AS VARCHAR) || '|' || p_brand AS m, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) || '|' || p_brand END AS mname, CAST(p_partkey AS VARCHAR) AS k, p_name FROM part),
      l1 AS (SELECT DISTINCT s AS id, 'size ' || lpad(s, 3, '0') AS name FROM p QUALIFY dense_rank() OVER (ORDER BY 'size ' || lpad(s, 3, '0'), s) <= 20),
      l3 AS (SELECT m, k, p_name FROM p QUALIFY row_number() OVER (PARTITION BY m ORDER BY p_name, k) <= 50), c3 AS (SELECT m, string_agg(k, ',' ORDER BY p_name, k) AS kids FROM l3 GROUP BY 1),
      l2 AS (SELECT DISTINCT s, m, mname FROM p QUALIFY dense_rank() OVER (PARTITION BY s ORDER BY mname, m) <= 50), c2 AS (SELECT s, string_agg(mname || '(' || coalesce(kids, '') || ')', ';' ORDER BY mname, l2.m) AS kids FROM l2 LEFT JOIN c3 ON c3.m = l2.m GROUP BY 1)
      SELECT l1.id, name, coalesce(kids, '') AS children FROM l1 LEFT JOIN c2 ON c2.s = l1.id""",
}
