"""Records, calls and vectors derived from the given tables; one SQL text serves Spark and DuckDB ({s}: its string type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CALLS = """
SELECT event_id AS id, concat('tenant_', CAST(user_id % 7 AS {s})) AS tenant_id,
  CASE event_type WHEN 'click' THEN 'analyze' WHEN 'view' THEN 'summarize' WHEN 'signup' THEN 'assign_codes' WHEN 'purchase' THEN 'detect_sensitive'
    ELSE CASE event_id % 4 WHEN 0 THEN 'analyze' WHEN 1 THEN 'summarize' WHEN 2 THEN 'assign_codes' ELSE 'detect_sensitive' END END AS operation,
  concat('call_', CAST(user_id AS {s}), '_', CAST(CAST(floor((day(ts) - 1) / 7) AS INT) AS {s})) AS call_id,
  ts, CAST(50 + (event_id * 37) % 1950 AS BIGINT) AS call_duration_ms,
  CASE WHEN event_type = 'error' THEN '' WHEN event_id % 3 = 0 THEN 'model_a' WHEN event_id % 3 = 1 THEN 'model_b' ELSE 'model_x' END AS model,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(100 + (event_id * 13) % 4000 AS BIGINT) END AS input_tokens,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(10 + (event_id * 7) % 500 AS BIGINT) END AS output_tokens,
  CAST(CAST(round(value * 100) AS BIGINT) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(12,6)) AS cost_usd,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN 'LLMError' END AS error_class
FROM events"""

_RECORDS = """
SELECT concat('doc-', CAST(d.doc_id AS {s})) AS id, d.source AS corpus_id, d.text AS content, d.lang AS language,
  CASE WHEN d.doc_id % 29 = 0 THEN '' WHEN d.doc_id % 31 = 0 THEN 'not-a-date' ELSE coalesce(substr(CAST(e.ts AS {s}), 1, 10), '') END AS created,
  concat('L1-', CAST(d.doc_id % 5 AS {s}), CASE WHEN d.doc_id % 7 = 0 THEN concat(', L1-', CAST((d.doc_id + 1) % 5 AS {s})) ELSE '' END) AS coding_level_1,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE concat('L2-', CAST(d.doc_id % 11 AS {s})) END AS coding_level_2,
  CASE WHEN d.doc_id % 4 = 0 THEN concat('L3-', CAST(d.doc_id % 17 AS {s})) END AS coding_level_3,
  d.doc_id AS pos
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 10"""

_VECTORS = """
SELECT v.vec_id AS pos, concat('doc-', CAST(v.vec_id AS {s})) AS id, CASE WHEN v.label = 9 THEN -1 ELSE v.label END AS label, v.embedding,
  CAST(length(d.text) AS BIGINT) AS n_chars, r.created
FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id JOIN records r ON r.pos = v.vec_id"""

_FRAMEWORK = """
SELECT concat('L1-', CAST(i AS {s})) AS node_id, CAST(NULL AS {s}) AS parent_id, concat('Topic ', CAST(i AS {s})) AS name, 1 AS level, i AS position
  FROM (SELECT DISTINCT CAST(n_nationkey AS INT) AS i FROM nation) n WHERE i < 6
UNION ALL SELECT concat('L2-', CAST(i AS {s})), concat('L1-', CAST(i % 5 AS {s})), concat('Theme ', CAST(i AS {s})), 2, i
  FROM (SELECT DISTINCT CAST(n_nationkey AS INT) AS i FROM nation) n WHERE i < 11
UNION ALL SELECT concat('L3-', CAST(i AS {s})), concat('L2-', CAST(i % 11 AS {s})), concat('Detail ', CAST(i AS {s})), 3, i
  FROM (SELECT DISTINCT CAST(n_nationkey AS INT) AS i FROM nation) n WHERE i < 17"""

_PRICES = """
SELECT CASE r_regionkey WHEN 0 THEN 'model_a' ELSE 'model_b' END AS model,
  CASE r_regionkey WHEN 0 THEN 0.000002e0 ELSE 0.0000004e0 END AS input_per_token, CASE r_regionkey WHEN 0 THEN 0.000006e0 ELSE 0.000002e0 END AS output_per_token
FROM region WHERE r_regionkey < 2"""

# For Spark the dates stand under the record's own id, so that texts are dealt by id once, and joins by id find them there.
_BY_ID = {
    "records": (
        "FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 10",
        "FROM (SELECT *, concat('doc-', CAST(doc_id AS {s})) AS _id FROM documents) d LEFT JOIN (SELECT concat('doc-', CAST(event_id DIV 10 AS {s})) AS _id, ts FROM events WHERE event_id % 10 = 0) e ON e._id = d._id",
        "concat('doc-', CAST(d.doc_id AS {s})) AS id",
        "d._id AS id",
    )
}

VIEWS = {"calls": _CALLS, "records": _RECORDS, "vectors": _VECTORS, "framework": _FRAMEWORK, "prices": _PRICES}
NEEDS = {"calls": ["events"], "records": ["documents", "events"], "vectors": ["embeddings", "documents", "records"], "framework": ["nation"], "prices": ["region"]}


#: Texts of records meet their dates by hash: dealt by id once and not sorted, the same plan at any size.
BY_HASH = "SHUFFLE_HASH(e)"


def view(spark: SparkSession, sf_dir: str, name: str, hint: str = "") -> DataFrame:
    """A given table or a derived view, without touching the session's catalog. hint: of joins in a derived view."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    text, args = VIEWS[name], {}
    if name in _BY_ID:
        old, new, id_old, id_new = _BY_ID[name]
        assert old in text and id_old in text
        text = text.replace(old, new).replace(id_old, id_new)
    text = text.format(s="STRING")
    if hint:
        text = text.replace("SELECT ", f"SELECT /*+ {hint} */ ", 1)
    for n in NEEDS[name]:
        text = _named(text, n)
        args[n] = view(spark, sf_dir, n)
    return spark.sql(text, **args)


def _named(text: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
    return text


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that starts with the named views: 'WITH a AS (...), ' and the rest of sql, which starts with 'WITH' or 'SELECT'."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS[n]:
            if x in VIEWS:
                add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    heads = ",\n".join(f"{n} AS ({VIEWS[n].format(s='VARCHAR')})" for n in order)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        body = body[len("WITH ") + len(recursive) :]
        return f"WITH {recursive}{heads},\n{body}"
    return f"WITH {heads}\n{body}"
