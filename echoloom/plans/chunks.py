"""Queries on vectors and chunks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import chunking as C
from ..operators import cluster
from ..operators import embedding as M
from ..views import view, with_views

TARGET = 2000


def _vectors(spark, d):
    return view(spark, d, "vectors").withColumn("corpus_id", F.lit("all"))


def _members(spark, d):
    return C.order_members(_vectors(spark, d), ["label"])


def e1_embedded(spark, d):
    """Vectors of a model in batches; they agree with those that functions of Spark make."""
    r = view(spark, d, "records").select("id", "content")
    v = M.embed(r, "content", M.hashing_model(32), 32).select("id", "vector")
    both = X.cosine_agreement(v, X.hashing_embed(r, "id", "content", 32), "id", "vector")
    return v.join(both, "id").select("id", F.round(X.norm(F.col("vector")), 4).alias("length"), F.round("cosine", 4).alias("cosine"))


def e3_pooled(spark, d):
    v = _vectors(spark, d).withColumn("mask", F.when(F.col("pos") % 3 > 0, 1).otherwise(0))
    return X.mean_pool_rows(v, ["label"], "embedding", "mask").select("label", F.posexplode("embedding").alias("k", "x")).select("label", "k", F.round("x", 6).alias("x"))


def e4_normalised(spark, d):
    v = _vectors(spark, d).select("id", X.l2_normalise(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(X.norm(F.col("v")), 6).alias("length"))


def e5_bad_width(spark, d):
    v = _vectors(spark, d).withColumn("embedding", F.when(F.col("pos") % 50 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return X.check_dim(v, "embedding", 64).select("id")


def e6_truncation(spark, d):
    r = view(spark, d, "records").select("language", F.floor(F.length("content") / 4).alias("n_tokens"))
    return X.truncation_report(r, "n_tokens", 512, ["language"])


def e7_agreement(spark, d):
    v = _vectors(spark, d).select("id", "embedding")
    other = v.select("id", F.transform("embedding", lambda x, i: F.when(i % 8 == 0, 0.0).otherwise(x)).alias("embedding"))
    return X.cosine_agreement(v, other, "id", "embedding").select("id", F.round("cosine", 6).alias("cosine"))


def _six(x):
    """x as a decimal number of 15 places, rounded to 6, halves away from zero: the same in any engine, as 41 / 640 = 0.0640625 is none that binary numbers hold."""
    return F.round(F.col(x).cast("decimal(18,15)"), 6).cast("double").alias(x)


def e8_hashed(spark, d):
    """Every place of the vectors of all texts, to six places."""
    return X.hashing_embed(view(spark, d, "records"), "id", "content", 16).select("id", F.posexplode("vector").alias("k", "x")).select("id", "k", _six("x"))


def f1_clusters(spark, d):
    return cluster.cluster_vectors(_vectors(spark, d), min_cluster_size=5)


def f2_small_corpora(spark, d):
    r = view(spark, d, "records").select("id", "corpus_id", (F.col("pos") % 4).cast("int").alias("label"))
    return C.small_corpora_as_noise(r, "corpus_id", "label", 51)


def f3_order(spark, d):
    return _members(spark, d).select("id", "label", "rn")


def f4_parts(spark, d):
    n = F.count("*").over(W.partitionBy("label"))
    return _members(spark, d).withColumn("n", n).select("id", *[C.balanced_part(F.col("rn"), F.col("n"), F.lit(p)).alias(f"of_{p}") for p in (1, 4, 7)])


def f5_part_counts(spark, d):
    return C.part_counts(_members(spark, d), ["label"], F.lit(TARGET)).select("label", "n", "total", "parts")


def f6_members(spark, d):
    return C.chunk_groups(_vectors(spark, d), target=TARGET)[0].select("id", "label", "chunk_id", "rn")


def f7_budget(spark, d):
    o = view(spark, d, "orders")
    return o.select("o_orderkey", C.effective_budget(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 9000), F.lit(4000)).alias("budget"))


def f8_chunks(spark, d):
    return C.chunk_groups(_vectors(spark, d), target=TARGET)[1]


def f9_coverage(spark, d):
    m, _ = C.chunk_groups(_vectors(spark, d), target=TARGET)
    broken = m.where("rn % 10 <> 3").select("id").unionByName(m.where("rn % 10 = 4").select("id"))
    return C.check_coverage(broken, _vectors(spark, d))


def f10_over_budget(spark, d):
    _, chunks = C.chunk_groups(_vectors(spark, d), target=TARGET)
    return C.check_budget(chunks, TARGET // 2).select("chunk_id", "n_records", "n_chars")


def f11_unpaired(spark, d):
    return C.check_pairs(_vectors(spark, d).where("pos % 7 > 0"), view(spark, d, "records"))


_ORD = "ord AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY NOT regexp_matches(trim(created), '^[0-9]{4}-[0-9]{2}'), CASE WHEN regexp_matches(trim(created), '^[0-9]{4}-[0-9]{2}') THEN trim(created) END, pos) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM vectors)"
_PART = lambda p: f"CASE WHEN rn < (n % {p}) * (n // {p} + 1) THEN rn // (n // {p} + 1) ELSE n % {p} + (rn - (n % {p}) * (n // {p} + 1)) // greatest(n // {p}, 1) END"
_CNT = f"""grp AS (SELECT label, max(n) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM ord GROUP BY 1),
  try AS (SELECT label, grp.n, total, unnest(range(greatest(CAST(ceil(total / ({TARGET} * 4)) AS BIGINT), 1), grp.n + 1)) AS p FROM grp WHERE total // 4 > {TARGET}),
  fit AS (SELECT label, p, bool_and(c <= {TARGET} * 4) OR p = max(n) AS ok FROM (SELECT t.label, t.p, t.n, {_PART('t.p').replace('rn', 'o.rn').replace('n %', 't.n %').replace('(n //', '(t.n //').replace(' n //', ' t.n //')} AS part, sum(n_chars) AS c FROM try t JOIN ord o ON o.label = t.label GROUP BY 1, 2, 3, 4) GROUP BY label, p),
  cnt AS (SELECT grp.label, n, total, coalesce((SELECT min(p) FROM fit WHERE fit.label = grp.label AND ok), 1) AS parts FROM grp)"""
_PLACED = f"""{_ORD}, {_CNT}, off AS (SELECT label, parts, CAST(coalesce(sum(parts) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM cnt),
  mem AS (SELECT id, o.label, first + {_PART('f.parts')} AS chunk_id, rn, n_chars FROM ord o JOIN off f ON f.label = o.label),
  chk AS (SELECT chunk_id, label, count(*) AS n_records, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM mem GROUP BY 1, 2)"""
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"

QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "ef" and k[1].isdigit() and callable(f)}
_GRAMS = lambda dim: f"""c AS (SELECT id, list_transform(string_split(lower(coalesce(content, '')), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM records),
  g AS (SELECT id, unnest(list_transform(range(1, len(c) - 1), lambda i: ((c[i] * {X.GRAM_BASE} + c[i + 1]) % {X.GRAM_PRIME} * {X.GRAM_BASE} + c[i + 2]) % {X.GRAM_PRIME} * {X.GRAM_STIR} % {X.GRAM_PRIME})) AS h FROM c),
  v AS (SELECT id, h % {dim} AS k, sum(CASE WHEN h // {dim} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM g GROUP BY 1, 2), l AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS l FROM v GROUP BY 1)"""  # noqa: E731
SQL = {
    "e1_embedded": with_views(f"WITH {_GRAMS(32)} SELECT r.id, CASE WHEN coalesce(l, 0) > 0 THEN 1e0 ELSE 0e0 END AS length, CASE WHEN coalesce(l, 0) > 0 THEN 1e0 ELSE 0e0 END AS cosine FROM records r LEFT JOIN l ON l.id = r.id", "records"),
    "e8_hashed": with_views(f"WITH {_GRAMS(16)} SELECT r.id, CAST(i AS INT) AS k, CAST(round(CAST(coalesce(CAST(v AS DOUBLE) / l, 0.0) AS DECIMAL(18,15)), 6) AS DOUBLE) AS x FROM (SELECT id, unnest(range(0, 16)) AS i FROM records) r LEFT JOIN v ON v.id = r.id AND v.k = i LEFT JOIN l ON l.id = r.id", "records"),
    "e3_pooled": with_views("""WITH x AS (SELECT label, pos, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM vectors)
      SELECT label, CAST(k AS INT) AS k, round(sum(CASE WHEN pos % 3 > 0 THEN CAST(x AS DOUBLE) ELSE 0 END) / greatest(count(*) FILTER (WHERE pos % 3 > 0), 1e-9), 6) AS x FROM x GROUP BY 1, 2""", "vectors"),
    "e4_normalised": with_views(f"WITH v AS (SELECT id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS v FROM vectors) SELECT id, round(v[1] / greatest({_NORM.format('v')}, 1e-12), 6) AS first, CAST(1 AS DOUBLE) AS length FROM v", "vectors"),
    "e5_bad_width": with_views("SELECT id FROM vectors WHERE pos % 50 = 0", "vectors"),
    "e6_truncation": with_views("SELECT language, count(*) AS n, count(*) FILTER (WHERE length(content) // 4 >= 512) AS n_capped FROM records GROUP BY 1", "records"),
    "e7_agreement": with_views(f"WITH v AS (SELECT id, embedding AS a, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 8 = 0 THEN 0.0 ELSE x END) AS b FROM vectors) SELECT id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE))) / greatest({_NORM.format('a')} * {_NORM.format('b')}, 1e-12), 6) AS cosine FROM v", "vectors"),
    "f2_small_corpora": with_views("SELECT id, corpus_id, CAST(CASE WHEN count(*) OVER (PARTITION BY corpus_id) < 51 THEN -1 ELSE pos % 4 END AS INT) AS label FROM records", "records"),
    "f3_order": with_views(f"WITH {_ORD} SELECT id, label, rn FROM ord", "vectors"),
    "f4_parts": with_views(f"WITH {_ORD} SELECT id, {', '.join(f'{_PART(p)} AS of_{p}' for p in (1, 4, 7))} FROM ord", "vectors"),
    "f5_part_counts": with_views(f"WITH {_ORD}, {_CNT} SELECT label, n, total, parts FROM cnt", "vectors"),
    "f6_members": with_views(f"WITH {_PLACED} SELECT id, label, chunk_id, rn FROM mem", "vectors"),
    "f7_budget": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 > 0 THEN least(o_orderkey % 9000, 4000) ELSE 4000 END AS BIGINT) AS budget FROM orders",
    "f8_chunks": with_views(f"WITH {_PLACED} SELECT 'all' AS corpus_id, chunk_id, label, n_records, n_chars, label = -1 AS is_uncategorised FROM chk", "vectors"),
    "f9_coverage": with_views(f"WITH {_ORD} SELECT id, CASE WHEN rn % 10 = 3 THEN 'missing' ELSE 'repeated' END AS problem FROM ord WHERE rn % 10 IN (3, 4)", "vectors"),
    "f10_over_budget": with_views(f"WITH {_PLACED} SELECT chunk_id, n_records, n_chars FROM chk WHERE n_chars // 4 > {TARGET // 2} AND n_records > 1", "vectors"),
    "f11_unpaired": with_views("SELECT id, 'record' AS side FROM records WHERE id NOT IN (SELECT id FROM vectors WHERE pos % 7 > 0)", "records", "vectors"),
}
