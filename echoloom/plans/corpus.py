"""Queries on corpora, sources and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..session import scratch_path
from ..sources import records as S
from ..streaming import streams as T
from ..views import view, with_views
from . import pii

FIELDS = ("coding_level_1", "coding_level_2", "coding_level_3")
SEED = 11


def _records(spark, d):
    return view(spark, d, "records")


def _leaves(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"))


def _total(leaves) -> int:
    return 23 * leaves.count() + 7


def a1_records(spark, d):
    """All records, written as JSON and read by schema; the metadata come back as a map."""
    path = scratch_path(spark, "records")
    keys = ["created", "coding_level_1", "coding_level_2", "coding_level_3"]
    _records(spark, d).select("id", "content", F.struct(*keys).alias("metadata")).write.json(path)
    back = S.metadata_struct(S.read_records(spark, path))
    return back.select("id", "content", *keys, F.col("_corrupt_record").isNotNull().alias("corrupt"))


def a3_lines(spark, d):
    """All turns through JSON lines."""
    path = scratch_path(spark, "turns")
    t = view(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    S.write_jsonl(t, path)
    return S.read_jsonl(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema))


def a4_log(spark, d):
    """The call log, appended in two parts and read back by window and tenant."""
    path, calls = scratch_path(spark, "log"), view(spark, d, "calls")
    for status in ("ok", "error"):
        S.append_calls(calls.where(F.col("status") == status).drop("id"), path)
    back = S.read_calls(spark, path, "tenant_2", "2024-01-05 06:00:00", "2024-01-20 00:00:00")
    return back.select("call_id", "operation", "call_duration_ms", "model", "cost_usd", "status", "error_class")


def a5_calls(spark, d):
    """The scan of the log with its window and tenant."""
    from ..operators.usage import calls_in_window

    return calls_in_window(view(spark, d, "calls"), "2024-01-10 00:00:00", "2024-01-12 00:00:00", "tenant_1").select("id", "operation", "cost_usd")


def a6_codebook(spark, d):
    """Codebooks made of parts, a book a brand: every other one in the form of fixed levels, the others as trees."""
    p = view(spark, d, "part").select("p_brand", F.concat(F.lit("all of "), "p_brand").alias("p_mfgr"), F.col("p_size").cast("string").alias("p_container"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("about"))
    tree = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    sensitive, examples = F.col("k") % 7 == 0, F.array("p_container", "name")
    code = F.struct("k", F.concat(F.lit("c"), "k").alias("code_id"), "name", F.col("about").alias("code_description"), examples.alias("examples"), sensitive.alias("sensitive"))
    low = p.groupBy("p_brand", "p_mfgr", "p_container").agg(F.array_sort(F.collect_list(code)).alias("codes"))
    both = low.groupBy("p_brand", "p_mfgr").agg(F.array_sort(F.collect_list(F.struct(F.col("p_container").alias("name"), "codes"))).alias("categories"))
    fixed = F.to_json(F.struct(F.array(F.struct(F.col("p_mfgr").alias("name"), "categories")).alias("types")))
    leaf = lambda x: F.struct(x["code_id"].alias("id"), x["name"].alias("name"), x["code_description"].alias("description"), x["examples"].alias("examples"), x["sensitive"].alias("sensitive"))
    nodes = F.transform("categories", lambda c: F.struct(F.concat(F.lit("g:"), c["name"]).alias("id"), c["name"].alias("name"), F.transform(c["codes"], leaf).alias("children")))
    free = F.to_json(F.struct(F.array(F.struct(F.lit("root").alias("id"), F.col("p_mfgr").alias("name"), nodes.alias("children"))).alias("root_codes")))
    books = both.select(F.col("p_brand").alias("book"), F.when(tree, free).otherwise(fixed).alias("value"))
    n = S.framework_nodes(books)
    return n.select("book", "node_id", "parent_id", "name", "level", "position", "description", F.array_join("examples", "|").alias("examples"), "sensitive", "feedback_type", "error")


def a8_payloads(spark, d):
    o = view(spark, d, "orders")
    insights = view(spark, d, "customer").select(F.col("c_custkey").alias("insight_id"), F.concat(F.lit('Say "why" '), F.col("c_custkey").cast("string")).alias("prompt"))
    links = o.select(F.col("o_custkey").alias("insight_id"), F.col("o_orderkey").alias("feedback_id"))
    feedback = o.select(F.col("o_orderkey").alias("feedback_id"), F.concat("o_orderpriority", F.lit("\n\\\r"), "o_orderstatus").alias("text"), F.col("o_orderdate").cast("string").alias("created_at"), F.lit("A").alias("coding_level_1"), F.col("o_orderstatus").alias("coding_level_2"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("coding_level_3"))
    p = S.build_payloads(insights, links, feedback, 5)
    ids = F.from_json("payload", "struct<prompt:string,feedback_records:array<struct<id:string,content:string,metadata:struct<created:string,coding_level_1:string,coding_level_2:string,coding_level_3:string>>>>")
    codes = lambda x: F.concat_ws(":", *[x["metadata"][k] for k in ("created", "coding_level_1", "coding_level_2", "coding_level_3")])
    return p.select("insight_id", "n", F.array_join(F.transform(ids["feedback_records"], lambda x: x["id"]), ",").alias("ids"), ids["feedback_records"][0]["content"].alias("first"), ids["prompt"].alias("prompt"), F.array_join(F.transform(ids["feedback_records"], codes), ";").alias("codes"))


def a9_pretty(spark, d):
    i = view(spark, d, "customer").select(F.col("c_custkey").alias("insight_id"))
    r = i.where("insight_id % 3 > 0").select("insight_id", F.to_json(F.struct(F.concat(F.lit('a"b '), F.col("insight_id").cast("string")).alias("pretty_output"))).alias("response"))
    return S.attach_pretty(i, r)


def i1_leaf_counts(spark, d):
    return C.leaf_counts(_records(spark, d), FIELDS)


def i1_siblings(spark, d):
    p = view(spark, d, "part").select(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("code"))
    c = p.groupBy("code").agg(F.count("*").alias("n")).withColumn("parent", F.substring_index("code", ":", 1))
    return C.siblings(c).select("parent", "n_siblings", F.array_join("codes", ",").alias("codes"))


def _carriers(spark, d):
    p = view(spark, d, "part").select(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("code"))
    c = p.groupBy("code").agg(F.count("*").alias("n")).withColumn("parent", F.substring_index("code", ":", 1))
    return C.select_carriers(c, SEED, min_carrier=2, min_sibling=1)


def i2_carriers(spark, d):
    return _carriers(spark, d)


def _fixed_carriers(spark):
    rows = [("spike", "L1-0"), ("step", "L2-3"), ("emerging", "L2-4"), ("rumour", "L3-8"), ("cross_code", "L3-0"), ("cross_code", "L3-4")]
    return spark.createDataFrame(rows, "pattern string, code string")


_CARRIERS = "carriers AS (SELECT * FROM (VALUES ('spike', 'L1-0'), ('step', 'L2-3'), ('emerging', 'L2-4'), ('rumour', 'L3-8'), ('cross_code', 'L3-0'), ('cross_code', 'L3-4')) v(pattern, code))"


def i3_patterns(spark, d):
    return C.assign_patterns(_records(spark, d), _fixed_carriers(spark), FIELDS)


def _planted(spark, d):
    return C.plant_dates(_records(spark, d), _fixed_carriers(spark), FIELDS, SEED)


def i4_densities(spark, d):
    # weighted by what each pattern has, so the curve follows the records
    n = i3_patterns(spark, d).groupBy("pattern").agg(F.count("*").alias("n"))
    return C.pattern_density(spark).join(n, "pattern").select("pattern", "month", F.round("weight", 6).alias("weight"), "n")


def i5_dates(spark, d):
    return _planted(spark, d).where("pattern <> 'rumour'").select("id", "created")


def i6_rumours(spark, d):
    return _planted(spark, d).where("pattern = 'rumour'").select("id", "created")


def i7_planted(spark, d):
    return _planted(spark, d).select("id", "pattern", "created", F.col("year").cast("bigint").alias("year"), "coding_level_1")


def i8_volumes(spark, d):
    leaves = _leaves(spark, d)
    return C.allocate_volumes(leaves, _total(leaves), SEED)


def i8_shrunk(spark, d):
    leaves = _leaves(spark, d)
    return C.allocate_volumes(leaves, 5 * leaves.count() + 3, SEED)


def i9_metadata(spark, d):
    """Metadata of specs whose codes are parts; the places are nations in their regions, weighted by their customers."""
    leaves = _leaves(spark, d)
    about = view(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_type").alias("feedback_type"), (F.col("p_partkey") % 7 == 0).alias("sensitive"))
    at = view(spark, d, "customer").join(view(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(view(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = at.groupBy(F.col("r_name").alias("country"), F.col("n_name").alias("region")).agg(F.count("*").alias("weight"))
    languages = view(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("weight"))
    m = C.sample_metadata(C.gen_specs(leaves, _total(leaves), SEED), SEED, leaves=about, places=places, languages=languages)
    return m.select("id", "code", "country", "region", "source", "language", "feedback_type", "sensitive", "year")


def i10_specs(spark, d):
    leaves = _leaves(spark, d)
    return C.gen_specs(leaves, _total(leaves), SEED)


def i11_merged(spark, d):
    r = _records(spark, d)
    specs = r.where("pos % 9 > 0").select("id", (F.col("pos") % 8).cast("int").alias("sentence_count"))
    texts = r.where("pos % 7 > 0").select("id", "content")
    m, missing, extra = C.merge_specs(specs, texts)
    none = F.lit(None).cast("boolean")
    return m.select("id", F.lit("merged").alias("part"), "mismatch").unionByName(missing.select("id", F.lit("missing").alias("part"), none.alias("mismatch"))).unionByName(extra.select("id", F.lit("extra").alias("part"), none.alias("mismatch")))


def i12_series(spark, d):
    return C.pattern_series(_planted(spark, d))


def i13_summary(spark, d):
    return C.pattern_summary(i3_patterns(spark, d), _fixed_carriers(spark))


def i15_checks(spark, d):
    f = view(spark, d, "framework").withColumn("feedback_type", F.concat(F.lit("type "), (F.col("position") % 3).cast("string")))
    kind = F.when(F.col("pos") % 8 > 0, F.concat(F.lit("type "), (F.col("pos") % 11 % 3).cast("string")))
    r = _records(spark, d).select("id", "pos", F.concat_ws(",", "coding_level_2", F.when(F.col("pos") % 6 == 0, " L9-9"), F.when(F.col("pos") % 10 == 0, "L1-4")).alias("codes"), (F.col("pos") % 17).alias("sentence_count"), kind.alias("feedback_type"))
    return C.corpus_checks(r.unionByName(r.where("pos % 25 = 0")), f)


def i16_profile(spark, d):
    return C.corpus_profile(_records(spark, d), "corpus_id", 10_000)


def j1_alerts(spark, d):
    s = view(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")
    rules = spark.createDataFrame([("error", "many", "sum", ">", 100.0), ("click", "low", "avg", "<", 20.0), ("view", "high", "avg", ">", 80.0)], "metric string, rule string, stat string, op string, limit double")
    a = T.window_alerts(s, rules)
    return a.select("metric", F.col("start").cast("string").alias("start"), F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), "rule")


def j2_usage(spark, d):
    c = view(spark, d, "calls").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.stream_usage(c).select(F.col("start").cast("string").alias("start"), "tenant_id", "operation", "total", "failed", "cost_usd")


def j3_invocations(spark, d):
    c = view(spark, d, "calls").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.stream_invocations(c, "6 hours").select("tenant_id", "operation", "call_id", F.col("start").cast("string").alias("start"), "n_calls", "call_duration_ms", "cost_usd")


def j4_intake(spark, d):
    """All records, some of them empty and some that give orders."""
    odd = F.when(F.col("pos") % 40 == 0, "").when(F.col("pos") % 41 == 1, F.concat(F.lit(" User : "), "content")).otherwise(F.col("content"))
    good, bad = T.intake(_records(spark, d).select("id", odd.alias("content"), "pos"))
    return good.select("id", F.md5(F.col("content").cast("binary")).alias("digest")).unionByName(bad.select("id", F.array_join("failed_rules", ",").alias("digest")))


def j5_trends(spark, d):
    return T.stream_trends(_records(spark, d), FIELDS)


def _u(key: str, seed: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


_CODES = f"codes AS (SELECT DISTINCT id, pos, unnest(list_filter(list_transform(string_split(concat_ws(',', {', '.join(FIELDS)}), ','), lambda x: trim(x)), lambda x: x <> '')) AS code FROM records)"
_PRIO = "list_position(['" + "', '".join(C.PRIORITY) + "'], pattern)"
_PAT = f"{_CODES}, {_CARRIERS}, pat AS (SELECT r.id, coalesce(min_by(pattern, {_PRIO}) FILTER (WHERE pattern IS NOT NULL), 'baseline') AS pattern FROM records r LEFT JOIN codes ON codes.id = r.id LEFT JOIN carriers ON carriers.code = codes.code GROUP BY 1)"
_DENS = f"""dens AS (SELECT p AS pattern, m AS month, CASE p WHEN 'spike' THEN 1.0 + {C.SPIKE_PEAK} * exp(-0.5 * pow((m - {C.SPIKE_MONTH}) / {C.SPIKE_WIDTH}, 2)) WHEN 'declining' THEN 1.0 + ({C.FALL} - 1.0) * (m / 11.0::DOUBLE)
   WHEN 'step' THEN CASE WHEN m < {C.STEP_MONTH} THEN 1.0 ELSE {C.STEP_RATIO} END WHEN 'baseline' THEN 1.0 ELSE 1.0 + ({C.RISE} - 1.0) * (m / 11.0::DOUBLE) END AS weight
   FROM (SELECT unnest(['spike', 'emerging', 'declining', 'step', 'cross_code', 'baseline']) AS p), (SELECT unnest(range(0, 12)) AS m))"""
_DATES = f"""edge AS (SELECT pattern, month, (sum(weight) OVER (PARTITION BY pattern ORDER BY month) - weight) / sum(weight) OVER (PARTITION BY pattern) AS lo, sum(weight) OVER (PARTITION BY pattern ORDER BY month) / sum(weight) OVER (PARTITION BY pattern) AS hi FROM dens),
  um AS (SELECT id, pattern, {_u('id', f'{SEED}:month')} AS u, {_u('id', f'{SEED}:day')} AS v FROM pat WHERE pattern <> 'rumour'),
  mon AS (SELECT um.id, um.pattern, v, CAST(DATE '{C.START}' + to_months(CAST(coalesce(month, 11) AS INT)) AS DATE) AS f FROM um LEFT JOIN edge ON edge.pattern = um.pattern AND u >= lo AND u < hi),
  planted AS (SELECT id, pattern, CAST(f + CAST(floor(v * day(last_day(f))) AS INT) AS VARCHAR) AS created FROM mon
    UNION ALL SELECT id, pattern, CAST(DATE '{C.START}' + CAST({C.EDGE_DAYS} + floor({_u("'window'", f'{SEED}:rumour')} * {366 - 2 * C.EDGE_DAYS - C.CLUSTER_DAYS}) + floor({_u('id', f'{SEED}:rumour')} * {C.CLUSTER_DAYS}) AS INT) AS VARCHAR) FROM pat WHERE pattern = 'rumour')"""
_PLANT = f"WITH {_PAT}, {_DENS}, {_DATES}"
_PCODE = "pc AS (SELECT p_brand || ':' || CAST(p_size AS VARCHAR) AS code, p_brand AS parent, count(*) AS n FROM part GROUP BY 1, 2)"


def _pick(p: str, cond: str, used: str) -> str:
    return f"{p} AS (SELECT '{p}' AS pattern, code FROM pc WHERE {cond} AND code NOT IN (SELECT code FROM {used}) ORDER BY {_u('code', f'{SEED}:{p}')}, code LIMIT 1), u_{p} AS (SELECT * FROM {used} UNION ALL SELECT * FROM {p})"


_I2 = f"""WITH {_PCODE}, el AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n DESC, code) AS r FROM pc QUALIFY r <= 3), par AS (SELECT parent FROM el GROUP BY 1 HAVING count(*) = 3 ORDER BY {_u('parent', f'{SEED}:cross_code')}, parent LIMIT 1),
  u0 AS (SELECT 'cross_code' AS pattern, code FROM el WHERE parent IN (SELECT parent FROM par)), {_pick('spike', 'n >= 2', 'u0')}, {_pick('step', 'n >= 2', 'u_spike')}, {_pick('emerging', 'n >= 2', 'u_step')}, {_pick('declining', 'n >= 2', 'u_emerging')}, {_pick('rumour', 'n BETWEEN 3 AND 12', 'u_declining')}
  SELECT * FROM u_rumour"""
_VOL = f"""rk AS (SELECT code, row_number() OVER (ORDER BY {_u('code', f'{SEED}:volume')}, code) AS rank FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS code FROM part)),
  v0 AS (SELECT *, CAST(CASE WHEN rank <= 5 THEN 130 WHEN rank <= 30 THEN 60 WHEN rank <= 100 THEN 30 ELSE 20 END AS BIGINT) AS n0, count(*) OVER () AS k FROM rk)"""
_GROWN = f"{_VOL}, tot AS (SELECT 23 * max(k) + 7 - sum(n0) AS d FROM v0), vol AS (SELECT code, CAST(n0 + d // k + CASE WHEN rank <= d % k THEN 1 ELSE 0 END AS BIGINT) AS n FROM v0, tot)"
_SPECS = f"""{_GROWN}, e AS (SELECT code, unnest(range(1, n + 1)) AS i FROM vol), o AS (SELECT code, i, {_u("code || '/' || i", f'{SEED}:order')} AS u FROM e),
  specs AS (SELECT 'doc-' || lpad(CAST(row_number() OVER (ORDER BY u, code, i) AS VARCHAR), CAST(greatest(4, CASE WHEN count(*) OVER () > 9999 THEN len(CAST(count(*) OVER () AS VARCHAR)) ELSE 4 END) AS INT), '0') AS id, code FROM o)"""


def _edges(name: str, table: str) -> str:
    return f"{name} AS (SELECT name, up, (s - w) / max(s) OVER (PARTITION BY up) AS lo, s / max(s) OVER (PARTITION BY up) AS hi FROM (SELECT *, sum(CAST(w AS DOUBLE)) OVER (PARTITION BY up ORDER BY name) AS s FROM {table}))"


def i14_sampled(spark, d):
    """A sample of fixed size, the same in every run."""
    return C.sample_records(_records(spark, d), 100, SEED).select("id", "corpus_id", "content")


def i14_half(spark, d):
    """Half of the records of one corpus."""
    r = _records(spark, d).where("corpus_id = 'src1'")
    return C.sample_records(r, r.count() // 2, SEED).select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "aij" and k[1].isdigit() and callable(f)}
_JB = "time_bucket(INTERVAL '5 minutes', ts)"
_J4 = "WITH recs0 AS (SELECT * REPLACE (CASE WHEN pos % 40 = 0 THEN '' WHEN pos % 41 = 1 THEN ' User : ' || content ELSE content END AS content), CASE WHEN pos % 40 = 0 OR coalesce(content, '') = '' THEN 'content_empty' WHEN length(content) > 100000 THEN 'content_long' WHEN pos % 41 = 1 THEN 'role_prefix' END AS bad FROM records), recs AS (SELECT * FROM recs0 WHERE bad IS NULL), " + (
    f"{pii._SPANS}, {pii._RESOLVED}, {pii._MAP.replace('corpus_id', 'id')}, {pii._replaced('placeholder').replace('USING (corpus_id', 'USING (id')}".replace("records", "recs") + " SELECT id, md5(content) AS digest FROM out UNION ALL SELECT id, bad FROM recs0 WHERE bad IS NOT NULL"
)
SQL = {
    "j4_intake": with_views(_J4, "records"),
    "a1_records": with_views("SELECT id, content, created, coding_level_1, coding_level_2, coding_level_3, false AS corrupt FROM records", "records"),
    "a3_lines": "SELECT conv_id, turn, role, text FROM conversations",
    "a4_log": with_views("SELECT call_id, operation, call_duration_ms, model, cost_usd, status, error_class FROM calls WHERE ts >= '2024-01-05 06:00:00' AND ts < '2024-01-20' AND tenant_id = 'tenant_2'", "calls"),
    "a5_calls": with_views("SELECT id, operation, cost_usd FROM calls WHERE ts >= '2024-01-10' AND ts < '2024-01-12' AND tenant_id = 'tenant_1'", "calls"),
    "a6_codebook": """WITH part_ AS (SELECT *, 'all of ' || p_brand AS p_mfgr, CAST(p_size AS VARCHAR) AS p_container FROM part), p AS (SELECT p_brand AS book, p_mfgr, p_container AS g, p_partkey AS k, p_name, p_type, CAST(right(p_brand, 1) AS INT) % 2 = 0 AS tree, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_container) - 1 AS j, row_number() OVER (PARTITION BY p_brand, p_container ORDER BY p_partkey) - 1 AS i FROM part_),
      q AS (SELECT *, CASE WHEN tree THEN 'root' ELSE 'type-0' END AS top, CASE WHEN tree THEN 'g:' || g ELSE 'category-0-' || j END AS mid FROM p)
      SELECT DISTINCT book, top AS node_id, NULL::VARCHAR AS parent_id, p_mfgr AS name, 1 AS level, 0 AS position, '' AS description, '' AS examples, false AS sensitive, p_mfgr AS feedback_type, NULL::VARCHAR AS error FROM q
      UNION ALL SELECT DISTINCT book, mid, top, g, 2, CAST(j AS INT), '', '', false, p_mfgr, NULL FROM q
      UNION ALL SELECT book, 'c' || k, mid, p_name, 3, CAST(i AS INT), p_type, g || '|' || p_name, k % 7 = 0, p_mfgr, NULL FROM q""",
    "a8_payloads": """WITH r AS (SELECT o_custkey AS insight_id, o_orderkey, o_orderpriority || ' ' || chr(92) || o_orderstatus AS t, concat_ws(':', CAST(o_orderdate AS VARCHAR), 'A', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS VARCHAR) DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY r <= 5)
      SELECT insight_id, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) AS ids, min_by(t, r) AS first, 'Say "why" ' || insight_id AS prompt, string_agg(c, ';' ORDER BY r) AS codes FROM r GROUP BY insight_id""",
    "a9_pretty": "SELECT c_custkey AS insight_id, CASE WHEN c_custkey % 3 > 0 THEN 'a\"b ' || c_custkey END AS pretty_output FROM customer",
    "i1_leaf_counts": with_views(f"WITH {_CODES} SELECT code, count(*) AS n, code AS parent FROM codes GROUP BY 1", "records"),
    "i1_siblings": f"WITH {_PCODE} SELECT parent, count(*) AS n_siblings, string_agg(code, ',' ORDER BY code) AS codes FROM pc GROUP BY 1",
    "i2_carriers": _I2,
    "i3_patterns": with_views(f"WITH {_PAT} SELECT * FROM pat", "records"),
    "i4_densities": with_views(f"WITH {_PAT}, {_DENS} SELECT dens.pattern, CAST(month AS INT) AS month, round(weight, 6) AS weight, n FROM dens JOIN (SELECT pattern, count(*) AS n FROM pat GROUP BY 1) x ON x.pattern = dens.pattern", "records"),
    "i5_dates": with_views(f"{_PLANT} SELECT id, created FROM planted WHERE pattern <> 'rumour'", "records"),
    "i6_rumours": with_views(f"{_PLANT} SELECT id, created FROM planted WHERE pattern = 'rumour'", "records"),
    "i7_planted": with_views(f"{_PLANT} SELECT p.id, pattern, p.created, CAST(substr(p.created, 1, 4) AS BIGINT) AS year, r.coding_level_1 FROM planted p JOIN records r ON r.id = p.id", "records"),
    "i8_volumes": f"WITH {_GROWN} SELECT * FROM vol",
    "i8_shrunk": f"""WITH {_VOL}, need AS (SELECT sum(n0) - 5 * max(k) - 3 AS d FROM v0), x AS (SELECT max(x) AS x FROM (SELECT x, sum(least(n0 - 1, x)) AS cut FROM v0, (SELECT unnest(range(0, 130)) AS x) GROUP BY x), need WHERE cut <= d),
      s AS (SELECT code, n0, rank, n0 - 1 > x AS high, least(n0 - 1, x) AS cut, (SELECT d FROM need) - sum(least(n0 - 1, x)) OVER () AS rest FROM v0, x)
      SELECT code, CAST(n0 - cut - CASE WHEN high AND row_number() OVER (PARTITION BY high ORDER BY rank) <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM s""",
    "i9_metadata": f"""WITH {_SPECS}, pl AS (SELECT r_name AS country, n_name AS region, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
      src(name, w) AS (VALUES {", ".join(f"('{k}', {w}::DOUBLE)" for k, w in C.SOURCES.items())}), {_edges("ce", "(SELECT country AS name, '' AS up, sum(w) AS w FROM pl GROUP BY 1)")}, {_edges("re", "(SELECT region AS name, country AS up, w FROM pl)")}, {_edges("se", "(SELECT name, '' AS up, w FROM src)")},
      {_edges("le", "(SELECT lang AS name, '' AS up, count(*) AS w FROM documents WHERE lang IS NOT NULL GROUP BY 1)")},
      u AS (SELECT id, code, {_u('id', f'{SEED}:country')} AS uc, {_u('id', f'{SEED}:region')} AS ur, {_u('id', f'{SEED}:source')} AS us, {_u('id', f'{SEED}:language')} AS ul, {_u('id', f'{SEED}:flip')} AS uf FROM specs)
      SELECT id, code, ce.name AS country, re.name AS region, se.name AS source, le.name AS language, p_type AS feedback_type, (p_partkey % 7 = 0) <> (uf < 0.05) AS sensitive, 2020 AS year
      FROM u JOIN part ON CAST(p_partkey AS VARCHAR) = code JOIN ce ON uc >= ce.lo AND uc < ce.hi JOIN re ON re.up = ce.name AND ur >= re.lo AND ur < re.hi JOIN se ON us >= se.lo AND us < se.hi JOIN le ON ul >= le.lo AND ul < le.hi""",
    "i10_specs": f"WITH {_SPECS} SELECT * FROM specs",
    "i11_merged": with_views(r"""WITH s AS (SELECT id, content, pos, CASE WHEN trim(content) = '' THEN 0 ELSE greatest(len(list_filter(string_split_regex(trim(content), '[.!?]+\s+|\n'), lambda x: trim(x) <> '')), 1) END AS k FROM records)
      SELECT id, CASE WHEN pos % 9 > 0 AND pos % 7 > 0 THEN 'merged' WHEN pos % 9 > 0 THEN 'missing' ELSE 'extra' END AS part, CASE WHEN pos % 9 > 0 AND pos % 7 > 0 THEN abs(k - pos % 8) > 1 END AS mismatch FROM s WHERE pos % 9 > 0 OR pos % 7 > 0""", "records"),
    "i12_series": with_views(f"{_PLANT} SELECT pattern, substr(created, 1, 7) AS month, count(DISTINCT id) AS n FROM planted GROUP BY 1, 2", "records"),
    "i13_summary": with_views(f"WITH {_PAT} SELECT pat.pattern, count(*) AS n, coalesce((SELECT string_agg(code, ', ' ORDER BY code) FROM carriers c WHERE c.pattern = pat.pattern), '') AS carriers FROM pat GROUP BY 1", "records"),
    "i14_sampled": with_views(f"SELECT id, corpus_id, content FROM records ORDER BY md5('{SEED}:' || id), id LIMIT 100", "records"),
    "i14_half": with_views(f"SELECT id, md5(content) AS digest FROM records WHERE corpus_id = 'src1' ORDER BY md5('{SEED}:' || id), id LIMIT (SELECT count(*) // 2 FROM records WHERE corpus_id = 'src1')", "records"),
    "i15_checks": with_views("""WITH r AS (SELECT id, pos, concat_ws(',', coding_level_2, CASE WHEN pos % 6 = 0 THEN ' L9-9' END, CASE WHEN pos % 10 = 0 THEN 'L1-4' END) AS codes, CASE WHEN pos % 8 > 0 THEN 'type ' || pos % 11 % 3 END AS t FROM records), d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE pos % 25 = 0),
      c AS (SELECT id, t, unnest(list_transform(string_split(codes, ','), lambda x: trim(x))) AS code FROM r)
      SELECT id, 'repeated id' AS problem FROM r WHERE pos % 25 = 0 UNION ALL SELECT id, 'unknown code' FROM r WHERE pos % 6 = 0
      UNION ALL SELECT DISTINCT id, 'feedback type' FROM c JOIN framework ON node_id = code WHERE t IS DISTINCT FROM 'type ' || position % 3
      UNION ALL SELECT id, 'no code' FROM d WHERE trim(codes) = '' UNION ALL SELECT id, 'blank at comma' FROM d WHERE regexp_matches(codes, '\\s,|,\\s') UNION ALL SELECT id, 'sentence count' FROM d WHERE pos % 17 NOT BETWEEN 1 AND 15""", "records", "framework"),
    "i16_profile": with_views("SELECT corpus_id, count(*) AS n, CAST(sum(length(content)) // 4 AS BIGINT) AS tokens, CAST(sum(length(content)) // 4 AS DOUBLE) / 10000 AS times_cap, count(DISTINCT language) AS n_languages, count(DISTINCT coding_level_1) AS n_themes FROM records GROUP BY 1", "records"),
    "j1_alerts": f"""WITH w AS (SELECT event_type AS metric, {_JB} AS start, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2)
      SELECT metric, CAST(start AS VARCHAR) AS start, round(total, 4) AS total, round(mean, 4) AS mean, CASE metric WHEN 'error' THEN 'many' WHEN 'click' THEN 'low' ELSE 'high' END AS rule FROM w WHERE (metric = 'error' AND total > 100) OR (metric = 'click' AND mean < 20) OR (metric = 'view' AND mean > 80)""",
    "j2_usage": with_views("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, tenant_id, operation, count(*) AS total, count(*) FILTER (WHERE status <> 'ok') AS failed, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd FROM calls GROUP BY 1, 2, 3", "calls"),
    "j3_invocations": with_views("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY tenant_id, operation, call_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY tenant_id, operation, call_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT tenant_id, operation, call_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n_calls, CAST(sum(call_duration_ms) AS BIGINT) AS call_duration_ms, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd FROM s GROUP BY tenant_id, operation, call_id, k""", "calls"),
    "j5_trends": with_views(f"WITH codes AS (SELECT created, unnest(list_filter(list_transform(string_split(concat_ws(',', {', '.join(FIELDS)}), ','), lambda x: trim(x)), lambda x: x <> '')) AS code FROM records), p AS (SELECT code, strftime(TRY_CAST(CASE WHEN regexp_matches(created, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr(created, 1, 10) END AS DATE), '%G-W%V') AS period FROM codes) SELECT code, period, count(*) AS count FROM p WHERE period IS NOT NULL GROUP BY 1, 2", "records"),
}
