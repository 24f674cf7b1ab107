"""Labelled benchmark corpora: carriers of planted patterns, dates, volumes, metadata, and checks.

All chance comes from digests of a seed and a key, so that a retry, another engine or another partitioning gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parent_path
from .choices import choose, uniform
from .numbering import number_rows
from .trends import explode_codes

# Patterns in order of priority, their months and shapes.
PRIORITY = ("rumour", "spike", "cross_code", "step", "emerging", "declining")
START, MONTHS = "2020-01-01", 12
SPIKE_MONTH, SPIKE_WIDTH, SPIKE_PEAK = 5, 1.0, 8.0
RISE, FALL = 6.0, 1 / 6.0
STEP_MONTH, STEP_RATIO = 7, 5.0
CLUSTER_DAYS, EDGE_DAYS = 2, 60
TIERS = ((5, 130), (25, 60), (70, 30))
TAIL = 20


def leaf_counts(df: DataFrame, fields: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """(code, n, parent): records per leaf code."""
    rows = explode_codes(df.select(id_col, *fields), fields, [id_col]).distinct()
    return rows.groupBy("code").agg(F.count("*").alias("n")).withColumn("parent", parent_path(F.col("code")))


def siblings(counts: DataFrame) -> DataFrame:
    """(parent, n_siblings, codes) of parents."""
    return counts.groupBy("parent").agg(F.count("*").alias("n_siblings"), F.array_sort(F.collect_list("code")).alias("codes"))


def select_carriers(counts: DataFrame, seed: int, min_carrier: int = 15, min_sibling: int = 5, n_siblings: int = 3, rumour: tuple[int, int] = (3, 12)) -> DataFrame:
    """(pattern, code): the carriers of each pattern, none twice.

    cross_code takes the largest n_siblings codes under one parent that has as many of min_sibling or more; spike, step, emerging and declining one code of
    min_carrier or more each, rumour one whose size is in its range. Choices go by a digest of seed, pattern and code.
    """
    eligible = counts.where(F.col("n") >= min_sibling).withColumn("_r", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= n_siblings)
    full = eligible.groupBy("parent").agg(F.count("*").alias("_k")).where(F.col("_k") == n_siblings)
    parent = full.orderBy(uniform(F.col("parent"), f"{seed}:cross_code"), "parent").limit(1)
    out = eligible.join(parent, "parent", "left_semi").select(F.lit("cross_code").alias("pattern"), "code")
    for p in ("spike", "step", "emerging", "declining", "rumour"):
        ok = F.col("n").between(*rumour) if p == "rumour" else F.col("n") >= min_carrier
        one = counts.where(ok).join(out.select("code"), "code", "left_anti").orderBy(uniform(F.col("code"), f"{seed}:{p}"), "code").limit(1)
        out = out.unionByName(one.select(F.lit(p).alias("pattern"), "code"))
    return out


def _rank(pattern: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), pattern)


def assign_patterns(df: DataFrame, carriers: DataFrame, fields: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """(id, pattern): of the patterns of a record's codes the first by priority, else baseline. Carriers are a handful of rows (one or a few for each pattern)."""
    hits = explode_codes(df.select(id_col, *fields), fields, [id_col]).join(F.broadcast(carriers), "code").groupBy(id_col).agg(F.min_by("pattern", _rank(F.col("pattern"))).alias("pattern"))
    return df.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("pattern", F.lit("baseline")).alias("pattern"))


def pattern_density(spark: SparkSession) -> DataFrame:
    """(pattern, month, weight), months from 0."""
    m = F.col("month").cast("double")
    x = m / (MONTHS - 1)
    shapes = {
        "spike": 1.0 + SPIKE_PEAK * F.exp(-0.5 * F.pow((m - SPIKE_MONTH) / SPIKE_WIDTH, 2)),
        "emerging": 1.0 + (RISE - 1.0) * x,
        "declining": 1.0 + (FALL - 1.0) * x,
        "step": F.when(m < STEP_MONTH, 1.0).otherwise(STEP_RATIO),
        "cross_code": 1.0 + (RISE - 1.0) * x,
        "baseline": F.lit(1.0),
    }
    months = spark.range(MONTHS).select(F.col("id").cast("int").alias("month"))
    return months.select("month", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in shapes]), F.array(*shapes.values()))).alias("pattern", "weight")).select("pattern", "month", "weight")


def sample_dates(df: DataFrame, density: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """df (id, pattern) with created: a month by the weights of its pattern, then a day of that month."""
    total = F.sum("weight").over(W.partitionBy("pattern"))
    upto = F.sum("weight").over(W.partitionBy("pattern").orderBy("month"))
    edges = density.select("pattern", "month", ((upto - F.col("weight")) / total).alias("_lo"), (upto / total).alias("_hi"))
    lists = edges.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("month", "_lo", "_hi"))).alias("_e"))  # MONTHS items
    u, v = uniform(F.col(id_col), f"{seed}:month"), uniform(F.col(id_col), f"{seed}:day")
    placed = df.join(F.broadcast(lists), "pattern").withColumn("_u", u)
    month = F.coalesce(F.get(F.filter("_e", lambda e: (F.col("_u") >= e["_lo"]) & (F.col("_u") < e["_hi"])), F.lit(0))["month"], F.lit(MONTHS - 1))
    first = F.add_months(F.lit(START).cast("date"), month)
    return placed.withColumn("_f", first).withColumn("created", F.date_add("_f", F.floor(v * F.dayofmonth(F.last_day("_f"))).cast("int")).cast("string")).select(*df.columns, "created")


def sample_rumour_dates(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """df with created: all within CLUSTER_DAYS days, EDGE_DAYS or more from either end of the timeline."""
    span = F.datediff(F.add_months(F.lit(START).cast("date"), MONTHS), F.lit(START).cast("date")) - 2 * EDGE_DAYS - CLUSTER_DAYS
    centre = F.lit(EDGE_DAYS) + F.floor(uniform(F.lit("window"), f"{seed}:rumour") * span)
    return df.withColumn("created", F.date_add(F.lit(START).cast("date"), (centre + F.floor(uniform(F.col(id_col), f"{seed}:rumour") * CLUSTER_DAYS)).cast("int")).cast("string"))


def plant_dates(df: DataFrame, carriers: DataFrame, fields: tuple[str, ...], seed: int, id_col: str = "id") -> DataFrame:
    """df with pattern, created and year; codes stay as they are."""
    p = assign_patterns(df, carriers, fields, id_col)
    rumours = sample_rumour_dates(p.where("pattern = 'rumour'"), seed, id_col)
    dated = sample_dates(p.where("pattern <> 'rumour'"), pattern_density(df.sparkSession), seed, id_col).unionByName(rumours)
    return df.drop("created").join(dated, id_col).withColumn("year", F.substring("created", 1, 4).cast("int"))


def allocate_volumes(leaves: DataFrame, total: int, seed: int, floor: int = 1, tiers=TIERS, tail: int = TAIL) -> DataFrame:
    """(code, n): volumes by tiers over the leaves in seeded order, then nudged to the exact total.

    What is missing is spread evenly, one more to the first ones. What is too much is taken evenly as well, down to `floor`: the level at which all
    are cut off follows from the sorted volumes. Fails where total is below floor for each leaf.
    """
    drawn = leaves.select("code").distinct().withColumn("_u", uniform(F.col("code"), f"{seed}:volume"))
    ranked = number_rows(drawn, [], ["_u", "code"], "_r").select("code", (F.col("_r") + 1).alias("rank"))
    tops = [sum(count for count, _ in tiers[: k + 1]) for k in range(len(tiers))]
    tier, size = F.lit(len(tiers)), F.lit(tail)
    for k in reversed(range(len(tiers))):
        tier, size = F.when(F.col("rank") <= tops[k], k).otherwise(tier), F.when(F.col("rank") <= tops[k], tiers[k][1]).otherwise(size)
    v = ranked.withColumns({"_t": tier, "n0": size.cast("bigint")})
    # However many leaves there are, they have as many volumes as there are tiers and a tail: sums and cuts are those of these few rows.
    t = v.groupBy("_t").agg(F.first("n0").alias("n0"), F.count("*").alias("_c"))
    all_ = W.partitionBy()
    t = t.withColumn("_k", F.sum("_c").over(all_)).withColumn("_d", F.lit(total) - F.sum(F.col("n0") * F.col("_c")).over(all_))
    grown = F.col("n0") + F.floor(F.col("_d") / F.col("_k")) + F.when(F.col("rank") <= F.col("_d") % F.col("_k"), 1).otherwise(0)
    # Shrinking: all lose the same until some are at the floor. With volumes sorted, a cut x takes sum(min(n0 - floor, x)).
    t = t.withColumn("_s", F.col("n0") - floor)
    before = W.orderBy("_s", "_t").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_before", F.coalesce(F.sum(F.col("_s") * F.col("_c")).over(before), F.lit(0))).withColumn("_left", F.col("_k") - F.coalesce(F.sum("_c").over(before), F.lit(0)))
    t = t.withColumn("_cut", F.floor((-F.col("_d") - F.col("_before")) / F.col("_left")))
    x = F.max(F.when(F.col("_cut") <= F.col("_s"), F.col("_cut"))).over(all_)  # of the tiers from the first that fits, the first has the largest
    t = t.withColumn("_x", F.coalesce(x, F.lit(0))).withColumn("_taken", F.least("_s", "_x"))
    t = t.withColumn("_rest", -F.col("_d") - F.sum(F.col("_taken") * F.col("_c")).over(all_)).withColumn("_high", F.col("_s") > F.col("_x"))
    # Leaves above the cut are numbered by rank: those of earlier tiers that are not above it do not count.
    low = F.coalesce(F.sum(F.when(F.col("_high"), 0).otherwise(F.col("_c"))).over(W.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_low", low).drop("n0")
    v = v.join(F.broadcast(t), "_t")
    shrunk = F.col("n0") - F.col("_taken") - F.when((F.col("rank") - F.col("_low") <= F.col("_rest")) & F.col("_high"), 1).otherwise(0)
    return v.select("code", F.when(F.col("_d") >= 0, grown).otherwise(shrunk).cast("bigint").alias("n"))


# Shares of the ways in which feedback comes, of languages, and the countries with their regions, all alike.
SOURCES = {
    "hotline": 0.80,
    "web form": 0.05,
    "email": 0.05,
    "outbound call": 0.05,
    "survey": 0.025,
    "focus group": 0.015,
    "community feedback session": 0.005,
    "volunteer report": 0.005,
}
LANGUAGES = {"en": 1.0}
PLACES = {
    "Sierra Leone": ("Western Area", "Bo District", "Kenema District", "Kambia District"),
    "DRC": ("Nord-Kivu", "Sud-Kivu", "Ituri", "Tshopo"),
    "Senegal": ("Dakar", "Thiès", "Saint-Louis", "Ziguinchor"),
    "Liberia": ("Montserrado", "Bong", "Nimba", "Grand Bassa"),
    "Burkina Faso": ("Centre", "Hauts-Bassins", "Boucle du Mouhoun", "Sahel"),
    "Guinea": ("Conakry", "Kindia", "Nzérékoré", "Mamou"),
    "Côte d'Ivoire": ("Abidjan", "Bouaké", "Daloa", "Korhogo"),
}


def default_places(spark: SparkSession) -> DataFrame:
    """(country, region, weight) of PLACES."""
    return spark.createDataFrame([(c, r, 1.0) for c, rs in PLACES.items() for r in rs], "country string, region string, weight double")


def _shares(spark: SparkSession, name: str, shares: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(shares.items()), f"{name} string, weight double")


def sample_metadata(
    df: DataFrame, seed: int, id_col: str = "id", flip: float = 0.05, leaves: DataFrame | None = None, places: DataFrame | None = None, sources: DataFrame | None = None, languages: DataFrame | None = None
) -> DataFrame:
    """df with country, region, source, language, year, sensitive and, with leaves (code, feedback_type, sensitive), feedback_type.

    Country goes by the sum of the weights of its regions in places (country, region, weight), region by its weight inside that country; source and
    language by their tables (source, weight) and (language, weight). sensitive is the one of the row's code in leaves, or else the row's own,
    null counting as false, turned round for the share flip. Every choice has its own seed, so one table does not move another's draws.
    Codes that leaves lacks have a null feedback_type, and all is null that has no weights. A code that leaves repeats counts with its
    least row. Columns of these names are replaced (sensitive is read first); rows that share an id share their draws.
    """
    spark = df.sparkSession
    places = default_places(spark) if places is None else places
    out = choose(df, places.groupBy("country").agg(F.sum("weight").alias("weight")), "country", f"{seed}:country", id_col)
    out = choose(out, places, "region", f"{seed}:region", id_col, under="country")
    out = choose(out, _shares(spark, "source", SOURCES) if sources is None else sources, "source", f"{seed}:source", id_col)
    out = choose(out, _shares(spark, "language", LANGUAGES) if languages is None else languages, "language", f"{seed}:language", id_col)
    if leaves is not None:
        own = leaves.groupBy("code").agg(F.min(F.struct("feedback_type", "sensitive")).alias("_leaf"))
        out = out.drop("feedback_type", "sensitive").join(own, "code", "left").withColumns({"feedback_type": F.col("_leaf.feedback_type"), "sensitive": F.col("_leaf.sensitive")}).drop("_leaf")
    own = F.coalesce(F.col("sensitive"), F.lit(False)) if "sensitive" in out.columns else F.lit(False)
    return out.withColumns({"sensitive": own != (uniform(F.col(id_col), f"{seed}:flip") < flip), "year": F.lit(int(START[:4]))})


def gen_specs(leaves: DataFrame, total: int, seed: int) -> DataFrame:
    """(id, code): one row per record, in seeded order, ids doc-0001 and so on."""
    rows = allocate_volumes(leaves, total, seed).select("code", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    # Numbers without one sort of all rows: bins of the draw are counted, then numbered inside.
    rows = rows.withColumn("_u", uniform(F.concat_ws("/", "code", "i"), f"{seed}:order")).withColumn("_b", F.floor(F.col("_u") * 1024))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    base = counts.select("_b", (F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    n = F.col("_base") + F.row_number().over(W.partitionBy("_b").orderBy("_u", "code", "i"))
    return rows.join(F.broadcast(base), "_b").select(F.concat(F.lit("doc-"), F.lpad(n.cast("string"), len(str(total)) if total > 9999 else 4, "0")).alias("id"), "code")


def merge_specs(specs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, missing, extra): specs with the content of texts by id and mismatch (sentence counts differ by more than one); specs without a text; texts without a spec."""
    from ..functions.text import sentence_count

    merged = specs.join(texts.select("id", "content"), "id").withColumn("mismatch", F.abs(sentence_count(F.col("content")) - F.col("sentence_count")) > 1)
    return merged, specs.join(texts, "id", "left_anti"), texts.join(specs, "id", "left_anti")


def pattern_series(df: DataFrame) -> DataFrame:
    """(pattern, month, n): distinct records per month."""
    return df.groupBy("pattern", F.substring("created", 1, 7).alias("month")).agg(F.count_distinct("id").alias("n"))


def pattern_summary(df: DataFrame, carriers: DataFrame) -> DataFrame:
    """(pattern, n, carriers)."""
    names = carriers.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("carriers"))
    return df.groupBy("pattern").agg(F.count("*").alias("n")).join(names, "pattern", "left").select("pattern", "n", F.coalesce("carriers", F.lit("")).alias("carriers"))


def sample_records(df: DataFrame, n: int, seed: int, id_col: str = "id", bins: int = 1 << 16) -> DataFrame:
    """n records, all if there are no more: those whose digest (md5 of seed and id) is least, ties by id. The same ones every time, in the order of digests.

    Digests are counted by their first bits. All records of bins below the one where the counts reach n are taken where they lie,
    and only that bin is cut by a sort; the sample is then sorted in ranges, so no task sees all of it. Records that repeat an id have one digest; which of them are taken is not stated. A null id counts as empty.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    place = F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") / ((1 << 32) // bins)).cast("int")
    rows = df.select("*", digest.alias("_digest")).withColumn("_place", place)
    counts = sorted(rows.groupBy("_place").count().collect())  # `bins` numbers at most
    upto, edge = 0, None
    for at, c in counts:
        if upto + c > n:
            edge = at
            break
        upto += c
    if edge is None:
        return rows.orderBy("_digest", id_col).drop("_digest", "_place")
    last = rows.where(F.col("_place") == edge).orderBy("_digest", id_col).limit(n - upto)
    return rows.where(F.col("_place") < edge).unionByName(last).orderBy("_digest", id_col).drop("_digest", "_place")


def corpus_checks(df: DataFrame, framework: DataFrame, field: str = "codes") -> DataFrame:
    """(id, problem): repeated ids, codes that the framework lacks, no code, blanks round commas, a sentence count outside 1..15, and a feedback type other than that of a code.

    The type is looked at where both tables have a column feedback_type: it must be that of every code of the record that the framework knows. A
    record without a type agrees only with codes that have none.
    """
    repeated = df.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    typed = "feedback_type" in df.columns and "feedback_type" in framework.columns
    codes = explode_codes(df.select("id", field, *(["feedback_type"] if typed else [])), (field,), ["id", *(["feedback_type"] if typed else [])])
    known = framework.select(F.col("node_id").alias("code"), *([F.col("feedback_type").alias("_type")] if typed else [])).distinct().withColumn("_known", F.lit(True))
    met = codes.join(known, "code", "left")
    unknown = met.where("_known is null").select("id", F.lit("unknown code").alias("problem")).distinct()
    rules = F.array(
        F.when(F.trim(F.coalesce(F.col(field), F.lit(""))) == "", F.lit("no code")),
        F.when(F.col(field).rlike(r"\s,|,\s"), F.lit("blank at comma")),
        F.when(~F.col("sentence_count").between(1, 15), F.lit("sentence count")),
    )
    out = repeated.unionByName(unknown).unionByName(df.select("id", F.explode(F.array_compact(rules)).alias("problem")))
    if typed:
        other = met.where("_known and not (feedback_type <=> _type)").select("id", F.lit("feedback type").alias("problem")).distinct()
        out = out.unionByName(other)
    return out


def corpus_profile(df: DataFrame, by: str, cap: int = 100_000, cpt: int = 4) -> DataFrame:
    """(by, n, tokens, times_cap, n_languages, n_themes)."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.floor(F.sum(F.length("content")) / cpt).cast("bigint").alias("tokens"), (F.floor(F.sum(F.length("content")) / cpt) / cap).alias("times_cap"), F.count_distinct("language").alias("n_languages"), F.count_distinct("coding_level_1").alias("n_themes")
    )
