"""Queries on coding trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import date_sort_key, period_of
from ..operators import trends as R
from ..views import view, with_views

FIELDS = ("coding_level_1", "coding_level_2", "coding_level_3")
WEEKS = [f"2024-W{w:02d}" for w in range(1, 6)]


def _records(spark, d):
    return view(spark, d, "records")


def d1_periods(spark, d):
    odd = F.when(F.col("pos") % 37 == 0, "2024-13-01").when(F.col("pos") % 41 == 0, " 2024-02-30 ").when(F.col("pos") % 43 == 0, "2024-12-30").when(F.col("pos") % 47 == 0, "2024-1").otherwise(F.col("created"))
    return _records(spark, d).select("id", *[period_of(odd, p).alias(p) for p in ("day", "week", "month")])


def d2_codes(spark, d):
    return R.explode_codes(_records(spark, d), FIELDS, ["id"]).groupBy("id", "code").agg(F.count("*").alias("n"))


def d3_trends_day(spark, d):
    return R.coding_trends(_records(spark, d), period="day")


def d3_trends_week(spark, d):
    return R.coding_trends(_records(spark, d), fields=FIELDS, period="week")


def d3_trends_month(spark, d):
    return R.coding_trends(_records(spark, d), fields=FIELDS, period="month")


def d4_periods(spark, d):
    return R.trend_periods(_records(spark, d), period="day").select("corpus_id", F.array_join("periods", ",").alias("periods"))


def d5_diagnostics(spark, d):
    return R.trend_diagnostics(_records(spark, d), fields=("coding_level_3",))


def d6_grid(spark, d):
    r = _records(spark, d)
    return R.render_trends(R.coding_trends(r, fields=FIELDS), R.trend_periods(r))


def d7_struct(spark, d):
    r = _records(spark, d)
    out = R.trends_as_struct(R.coding_trends(r), R.trend_periods(r))
    return out.select("corpus_id", F.array_join("periods", ",").alias("periods"), F.array_join(F.transform("cells", lambda c: F.concat_ws("/", c["code"], c["period"], c["count"].cast("string"))), ",").alias("cells"))


def d8_top_codes(spark, d):
    top = R.top_varying_codes(R.coding_trends(_records(spark, d), fields=FIELDS), 8)
    return top.select("code", F.round("std", 6).alias("std"), F.col("total").cast("bigint").alias("total"))


def d9_pivot(spark, d):
    cells = R.coding_trends(_records(spark, d), fields=FIELDS)
    return R.pivot_trends(cells, R.top_varying_codes(cells, 8), WEEKS).select("code", *[F.col(w).cast("bigint").alias("p_" + w.replace("-", "_").lower()) for w in WEEKS])


def d10_sort_keys(spark, d):
    return _records(spark, d).select("id", date_sort_key(F.concat(F.lit(" "), "created")).alias("sort_key"))


def d11_default_period(spark, d):
    r = _records(spark, d).select("id", "created", F.when(F.col("pos") % 2 == 0, "month").alias("asked"))
    asked = F.coalesce("asked", F.lit(R.DEFAULT_PERIOD))
    return r.select("id", F.when(asked == "month", period_of(F.col("created"), "month")).otherwise(period_of(F.col("created"), "week")).alias("period"))


def _week(x: str) -> str:
    return f"strftime(TRY_CAST(CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr({x}, 1, 10) END AS DATE), '%G-W%V')"


def _codes(fields: tuple[str, ...], keep: str = "corpus_id") -> str:
    return f"codes AS (SELECT {keep}, created, pos, unnest(list_filter(list_transform(string_split(concat_ws(',', {', '.join(fields)}), ','), lambda x: trim(x)), lambda x: x <> '')) AS code FROM records)"


_DAY = "CASE WHEN regexp_matches(created, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN substr(created, 1, 10) END"
_MONTH = "CASE WHEN regexp_matches(created, '^[0-9]{4}-[0-9]{2}') THEN substr(created, 1, 7) END"


def _cells(fields: tuple[str, ...], period: str) -> str:
    return f"{_codes(fields)}, cells AS (SELECT corpus_id, code, {period} AS period, count(*) AS count FROM codes WHERE {period} IS NOT NULL GROUP BY ALL)"


_ALL = _cells(FIELDS, _week("created"))
_PERIODS = f"periods AS (SELECT DISTINCT corpus_id, {_week('created')} AS period FROM records WHERE {_week('created')} IS NOT NULL)"
_TOP = "per AS (SELECT code, period, sum(count) AS count FROM cells GROUP BY ALL), top AS (SELECT code, stddev_samp(count) AS std, sum(count) AS total FROM per GROUP BY 1 ORDER BY std DESC NULLS LAST, code LIMIT 8)"

QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "d" and k[1].isdigit() and callable(f)}
SQL = {
    "d1_periods": with_views(f"""WITH o AS (SELECT id, trim(CASE WHEN pos % 37 = 0 THEN '2024-13-01' WHEN pos % 41 = 0 THEN ' 2024-02-30 ' WHEN pos % 43 = 0 THEN '2024-12-30' WHEN pos % 47 = 0 THEN '2024-1' ELSE created END) AS created FROM records)
      SELECT id, {_DAY} AS day, {_week('created')} AS week, {_MONTH} AS month FROM o""", "records"),
    "d2_codes": with_views(f"WITH {_codes(FIELDS, 'id')} SELECT id, code, count(*) AS n FROM codes GROUP BY ALL", "records"),
    "d3_trends_day": with_views(f"WITH {_cells(R.FIELDS, _DAY)} SELECT * FROM cells", "records"),
    "d3_trends_week": with_views(f"WITH {_ALL} SELECT * FROM cells", "records"),
    "d3_trends_month": with_views(f"WITH {_cells(FIELDS, _MONTH)} SELECT * FROM cells", "records"),
    "d4_periods": with_views(f"SELECT corpus_id, string_agg(DISTINCT {_DAY}, ',' ORDER BY {_DAY}) AS periods FROM records WHERE {_DAY} IS NOT NULL GROUP BY 1", "records"),
    "d5_diagnostics": with_views(f"""WITH r AS (SELECT corpus_id, {_week('created')} IS NOT NULL AS dated, coalesce(trim(coding_level_3), '') <> '' AS coded FROM records)
      SELECT corpus_id, count(*) AS n_records, count(*) FILTER (WHERE dated) AS n_dated, count(*) FILTER (WHERE dated AND NOT coded) AS n_dated_uncoded, count(*) FILTER (WHERE dated) = 0 AS no_date FROM r GROUP BY 1""", "records"),
    "d6_grid": with_views(f"""WITH {_ALL}, {_PERIODS}, g AS (SELECT c.corpus_id, c.code, p.period, coalesce(x.count, 0) AS count FROM (SELECT DISTINCT corpus_id, code FROM cells) c JOIN periods p USING (corpus_id)
        LEFT JOIN cells x ON x.corpus_id = c.corpus_id AND x.code = c.code AND x.period = p.period),
      l AS (SELECT corpus_id, code, code || ',' || string_agg(CAST(count AS VARCHAR), ',' ORDER BY period) AS line FROM g GROUP BY corpus_id, code), h AS (SELECT corpus_id, 'code,' || string_agg(period, ',' ORDER BY period) AS head FROM periods GROUP BY 1)
      SELECT h.corpus_id, any_value(h.head) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY code), '') AS grid FROM h LEFT JOIN l ON h.corpus_id = l.corpus_id GROUP BY h.corpus_id""", "records"),
    "d7_struct": with_views(f"""WITH {_cells(R.FIELDS, _week('created'))}, {_PERIODS}, h AS (SELECT corpus_id, string_agg(period, ',' ORDER BY period) AS periods FROM periods GROUP BY 1)
      SELECT h.corpus_id, h.periods, coalesce(string_agg(code || '/' || period || '/' || count, ',' ORDER BY code, period), '') AS cells FROM h LEFT JOIN cells ON h.corpus_id = cells.corpus_id GROUP BY 1, 2""", "records"),
    "d8_top_codes": with_views(f"WITH {_ALL}, {_TOP} SELECT code, round(std, 6) AS std, CAST(total AS BIGINT) AS total FROM top", "records"),
    "d9_pivot": with_views(f"WITH {_ALL}, {_TOP} SELECT code, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE period = '{w}'), 0) AS BIGINT) AS p_{w.replace('-', '_').lower()}" for w in WEEKS) + " FROM per WHERE code IN (SELECT code FROM top) GROUP BY 1", "records"),
    "d10_sort_keys": with_views("SELECT id, CASE WHEN regexp_matches(trim(created), '^[0-9]{4}-[0-9]{2}') THEN trim(created) END AS sort_key FROM records", "records"),
    "d11_default_period": with_views(f"SELECT id, CASE WHEN pos % 2 = 0 THEN {_MONTH} ELSE {_week('created')} END AS period FROM records", "records"),
}
