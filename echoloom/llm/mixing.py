"""Mixing sources to target weights.

Sizes (words) are summed per source; a water-filling over the sources gives each its target;
a document is emitted floor(rate) times, rate = target / size of its source, plus one
hash-seeded Bernoulli copy. Drawing with the bare fraction leaves a source's share off by its
sampling noise, which is several per cent where a source has few or very unequal documents. So
the probability is set from a histogram of the draws (fixed number of bins per source, summed
map-side) such that the words of the copies come nearest to the fraction of the source's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table

#: Bins of the histogram of draws, for each source.
BINS = 4096
MAX_RATE = 3
#: More sources than this are joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform_bin(id_col: Column, seed: int) -> Column:
    """Bin 0..BINS-1 of a document's draw; md5 so that any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(BINS)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, source_size) the targets.

    Sources in order of their code points (null last) weigh 1, 2, 3, 1, ... and share all words;
    a target stops at MAX_RATE times its source's size and the excess is shared again by weight.
    The sources at their limit are those with the smallest limit per weight, so one pass over the
    ordered sources finds them: k sources are at their limit when the level that the others would
    get no longer exceeds any limit per weight. It is a window over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("_cap", MAX_RATE * F.col("source_size").cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    whole = W.partitionBy()
    upto = W.orderBy(F.col("_r"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_all", F.sum("source_size").over(whole).cast("double")).withColumn("_aw", F.sum("_w").over(whole))
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / (F.col("_aw") - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))))
    # The first source whose limit is not below the level sets the level for all that follow.
    s = s.withColumn("_fixed", F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", F.col("source").isNull().alias("_null"), F.col("source").alias("_src"), "_level"))).over(whole))
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_fixed._level"), F.col("_cap"))).alias("target"))


def with_rates(sized: DataFrame, seed: int = 7) -> tuple[DataFrame, bool]:
    """From rows with (source, _size, _bin) a row per source with target, base copies and the highest bin that gets one more.

    A source of size 0 has target 0 and rate 0.
    """
    hist = sized.groupBy("source", "_bin").agg(F.sum("_size").alias("_mass"))
    sizes = hist.groupBy("source").agg(F.sum("_mass").alias("source_size"))
    targets = source_targets(sizes)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("_base", F.floor(rate + 1e-9).cast("long")).withColumn("_want", F.greatest(F.col("target") - F.col("_base") * F.col("source_size"), F.lit(0.0)))
    h, t = hist.alias("h"), targets.alias("t")
    run = W.partitionBy("h.source").orderBy("h._bin")  # at most BINS rows for a source
    steps = h.join(t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.source", "_bin", "_want", F.sum("_mass").over(run).alias("_cum"))
    # Of all cuts, none included (bin -1), the one whose words are nearest to what is wanted.
    cut = steps.groupBy("source").agg(F.min(F.struct(F.abs(F.col("_cum") - F.col("_want")).alias("_off"), F.col("_bin"))).alias("_best"), F.first("_want").alias("_want2"))
    cut = cut.select(F.col("source").alias("_cs"), F.when(F.col("_best._off") < F.col("_want2"), F.col("_best._bin")).otherwise(-1).alias("_cut"))
    rates = targets.join(cut, targets["source"].eqNullSafe(cut["_cs"])).select(F.col("source").alias("_source"), "source_size", "target", "_base", "_cut")
    return rates


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies (and the columns in carry, renamed _c0, ...).

    Size is the number of words; null text has 0. The draw depends on seed and id alone, so reruns
    and retries agree; rows with the same id (or null ids) share their draw. No row is taken more than
    MAX_RATE times. Null is a source of its own, the last. An empty table gives an empty result.
    """
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry or [])]
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("_size"), _uniform_bin(F.col(id_col), seed).alias("_bin"), *carried)
    rates = with_rates(sized.select("source", "_size", "_bin"), seed)
    from .common import settle

    rates = settle(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    copies = F.least(F.col("_base") + F.when(F.col("_bin") <= F.col("_cut"), 1).otherwise(0), F.lit(MAX_RATE)).cast("long")
    out = sized.join(rates, sized["source"].eqNullSafe(rates["_source"]), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"), copies.alias("copies"), *[f"_c{i}" for i in range(len(carried))])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mixture itself: every row of docs as often as it is taken, with its own columns, whatever their names; nulls, repeats, long texts and empty tables as in mix_counts."""
    out = mix_counts(docs, id_col, text_col, source_col, seed, carry=docs.columns)
    out = out.where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("copies")


SQL = {
    "op9_mix_sources": rf"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) % {BINS} AS bin FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0 * source_size AS cap FROM s),
    l AS (SELECT *, cap / w AS r, (CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
    f AS (SELECT level FROM l WHERE r >= level ORDER BY r, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(w * (SELECT level FROM f), CAST(cap AS DOUBLE))) AS target FROM l),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS base FROM t),
    g AS (SELECT *, greatest(target - base * source_size, 0.0) AS want FROM b),
    h AS (SELECT source, bin, sum(size) AS mass FROM d GROUP BY ALL),
    c AS (SELECT h.source, bin, want, sum(mass) OVER (PARTITION BY h.source ORDER BY bin) AS cum
      FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
    k AS (SELECT source, CASE WHEN min(abs(cum - want)) < any_value(want) THEN arg_min(bin, (abs(cum - want), bin)) ELSE -1 END AS cut FROM c GROUP BY source)
    SELECT d.doc_id, d.size, g.source_size, g.target,
      CAST(d.size * least(g.base + CASE WHEN d.bin <= k.cut THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN k ON d.source IS NOT DISTINCT FROM k.source"""
}
QUERIES = {"op9_mix_sources": op9_mix_sources}
