"""Codes of a framework for records, level by level, all records in one job a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.text import parse_score, parse_selected
from ..session import settled
from .call_log import CallLog
from .complete import INJECTION, Complete, complete
from .validate import injection


CYCLE, ORPHAN, REPEATED, UNNAMED = "cycle", "unknown parent", "repeated id", "no id"
#: The options of a framework of more nodes are joined by shuffle, not broadcast.
MAX_NODES = 100_000


def framework_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path ids, names, order, depth, is_leaf, min_leaf_depth, max_leaf_depth, error) of a table (node_id, parent_id, name, position).

    Frameworks of any depth: each node points at an ancestor and holds the path down from it; a round joins a node's pointer with that
    ancestor's own, so paths double and a chain of a thousand levels takes ten rounds. Only nodes that have not reached a root
    go on. Depths of leaves are those below a node, counted from the root. A node without a path to a root has an error
    in place of one: itself or an ancestor stands in a cycle, names a parent that is not there, has no id, or has an id that others have too
    (each such row is returned). A node all of whose leaves have errors has no depths of leaves. An empty table gives an empty result.
    """
    n = settled(nodes.select("node_id", "parent_id", "name", "position"))
    ids = n.groupBy("node_id").agg(F.count("*").alias("_c"))
    parents = n.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.lit(True).alias("_inner"))
    known = ids.join(parents, "node_id", "left").select(F.col("node_id").alias("_id"), "_c", F.coalesce("_inner", F.lit(False)).alias("_inner"))
    own = n.join(known, n["node_id"].eqNullSafe(known["_id"])).drop("_id")
    above = ids.where("node_id is not null").select(F.col("node_id").alias("_p"), F.col("_c").alias("_pc"))
    own = own.join(above, own["parent_id"] == above["_p"], "left")
    error = F.when(F.col("node_id").isNull(), UNNAMED).when(F.col("_c") > 1, REPEATED).when(F.col("parent_id").isNotNull() & F.col("_p").isNull(), ORPHAN).when(F.col("_pc") > 1, REPEATED)
    state = own.select("node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("path"), F.array("name").alias("names"), F.array("position").alias("order"), (~F.col("_inner")).alias("is_leaf"), error.alias("error"))
    state = settled(state)
    ended = state.where("up is null or error is not null")
    open_ = state.where("up is not null and error is null")
    done = ended
    while not open_.isEmpty():
        # Whoever is pointed at is in one of the two: it has ended, or goes on itself.
        target = done.unionByName(open_).where("error is null or node_id is not null").select(F.col("node_id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in ("path", "names", "order", "error")]).where("up is not null")
        target = target.groupBy("up").agg(*[F.first(c).alias(c) for c in ("_up", "_path", "_names", "_order", "_error")])
        longer = open_.join(target, "up").select(
            "node_id", F.col("_up").alias("up"), *[F.concat(f"_{c}", c).alias(c) for c in ("path", "names", "order")], "is_leaf", F.col("_error").alias("error")
        )
        # A path that meets a node twice has gone round.
        looped = F.when(F.size(F.array_distinct("path")) < F.size("path"), CYCLE)
        state = settled(longer.withColumn("error", F.coalesce("error", looped)))
        done = settled(done.unionByName(state.where("up is null or error is not null")))
        open_ = state.where("up is not null and error is null")
    whole = done.where("error is null").withColumn("depth", F.size("path"))
    below = whole.where("is_leaf").select(F.explode("path").alias("node_id"), F.col("depth").alias("_d")).groupBy("node_id").agg(F.min("_d").alias("min_leaf_depth"), F.max("_d").alias("max_leaf_depth"))
    columns = ["node_id", "path", "names", "order", "depth", "is_leaf", "min_leaf_depth", "max_leaf_depth", "error"]
    failed = done.where("error is not null").select("node_id", "is_leaf", "error")
    return whole.join(below, "node_id", "left").select(*columns).unionByName(failed, allowMissingColumns=True).select(*columns)


def nest_framework(l1: DataFrame, l2: DataFrame, l3: DataFrame, limits: tuple[int, int, int] = (20, 50, 50)) -> DataFrame:
    """One row per first-level node with its children nested: sorted by name, so many at most for each parent. Tables (id, name, parent_id); a missing name is the id."""

    def best(df: DataFrame, by: list[str], k: int) -> DataFrame:
        named = df.withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("id")))
        w = W.partitionBy(*by).orderBy("name", "id") if by else W.orderBy("name", "id")
        return named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

    def nested(df: DataFrame, *more: str) -> DataFrame:
        return df.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", *more))).alias("children")).withColumnRenamed("parent_id", "_p")

    top = best(l1, [], limits[0]).select("id", "name")
    low = nested(best(l3, ["parent_id"], limits[2]))
    mid = best(l2, ["parent_id"], limits[1]).join(low, F.col("id") == F.col("_p"), "left").select("id", "name", "parent_id", F.coalesce("children", F.array().cast(low.schema["children"].dataType)).alias("children"))
    mid = nested(mid, "children")
    return top.join(mid, F.col("id") == F.col("_p"), "left").select("id", "name", F.coalesce("children", F.array().cast(mid.schema["children"].dataType)).alias("children"))


def score_paths(df: DataFrame, scores: str = "scores", why: str = "whys") -> DataFrame:
    """Adds confidence, the smallest score, and explanation, one sentence for each level."""
    text = F.array_join(F.transform(F.arrays_zip(scores, why), lambda x, i: F.concat(F.format_string("Level %d (%.2f): ", i + 1, x[scores]), x[why])), " ")
    return df.withColumns({"confidence": F.array_min(scores), "explanation": text})


def top_codes(df: DataFrame, by: str, k: Column | int, score: str = "confidence", seq: str = "seq") -> DataFrame:
    """The k rows of each record with the highest score; ties by seq, the order in which they would be found depth first."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), seq))
    return df.withColumn("rank", rn).where(F.col("rank") <= (k if isinstance(k, Column) else F.lit(k)))


def path_columns(df: DataFrame, path: str = "path", names: str = "names", scores: str = "scores") -> DataFrame:
    """Three levels as columns, null where the path is shorter; deeper ones are left out."""
    return df.withColumns({f"code_{k + 1}_{c}": F.get(src, F.lit(k)) for k in range(3) for c, src in (("id", path), ("name", names), ("confidence", scores))})


def assign_codes(records: DataFrame, nodes: DataFrame, pick: Complete, judge: Complete, max_codes: int = 10, threshold: float | None = None, id_col: str = "id", log: CallLog | None = None) -> DataFrame:
    """Rows (id, rank, code columns of three levels, confidence, explanation, error_class) of each record.

    For each level of the framework: all records at all open nodes are asked to choose among its children, each choice is
    judged, choices below the threshold go, leaves are kept and the others are asked again. A record that looks like an injection,
    or any of whose calls fails or is answered with a score that cannot be read, has no codes but one row with error_class.

    A text is read once and stays with its record: both calls of a level are made in one pass over the rows where they lie, which writes
    the texts of records that go on beside their paths. No text is dealt by id or node, unless a framework has more than
    MAX_NODES nodes. Records without an id are left out. Calls are logged when both calls of their level are made.
    """
    n = settled(nodes.select("node_id", "parent_id", "name", "position").withColumn("at", F.coalesce("parent_id", F.lit(""))))
    inner = n.select(F.col("at").alias("_at"), F.lit(True).alias("inner")).distinct()
    listed = n.join(inner, n["node_id"] == inner["_at"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    options = settled(listed.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("position", "node_id", "name", "inner"))).alias("options")))
    if n.count() <= MAX_NODES:
        options = F.broadcast(options)
    blank = lambda t: F.array().cast(t)
    state = ("path", "names", "scores", "whys", "seq")
    front = records.where((F.coalesce(F.length("content"), F.lit(0)) > 0) & F.col(id_col).isNotNull()).select(
        id_col, "content", injection(F.col("content")).isNotNull().alias("blocked"), F.lit("").alias("at"),
        blank("array<string>").alias("path"), blank("array<string>").alias("names"), blank("array<double>").alias("scores"), blank("array<string>").alias("whys"), blank("array<int>").alias("seq"),
    )
    found = failed = None
    while True:
        asked = front.join(options, "at")
        asked = asked.withColumns({"system": P.system_message("pick"), "user": P.pick_message(F.col("content"), F.col("names"), F.transform("options", lambda o: o["name"]))})
        got = complete(asked.drop("at"), pick, out="picked", blocked="blocked").select(id_col, "content", *state, "options", "picked")
        chosen = F.transform(parse_selected(F.col("picked.content"), F.size("options")), lambda i: F.struct(i.alias("i"), F.get("options", i).alias("o")))
        # A row for each choice, and one for a call without any; its answer stands in the first.
        got = got.select(id_col, "content", *state, "picked", F.posexplode_outer(F.when(F.col("picked.status") == "ok", chosen)).alias("_k", "c"))
        got = got.select(
            id_col, "content", F.concat("path", F.array("c.o.node_id")).alias("path"), F.concat("names", F.array("c.o.name")).alias("names"), "scores", "whys", F.concat("seq", F.array("c.i")).alias("seq"),
            F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("picked")).alias("picked"), F.col("c").isNotNull().alias("chosen"), F.col("c.o.inner").alias("inner"),
        )
        asked = got.withColumns({"system": P.system_message("code_judge"), "user": P.code_judge_message(F.col("content"), F.col("names"))})
        scored = complete(asked, judge, only="chosen").drop("system", "user").withColumn("score", parse_score(F.col("completion.content"))["score"])
        good = F.col("score").isNotNull() if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
        scored = scored.withColumn("good", F.col("chosen") & good).withColumn("goes_on", F.col("good") & F.col("inner"))
        why = F.coalesce(F.get(F.split("completion.content", "\n", 2), F.lit(1)), F.lit(""))
        level = settled(scored.select(
            id_col, F.when(F.col("goes_on"), F.col("content")).alias("content"), F.element_at("path", -1).alias("at"), "path", "names", F.concat("scores", F.array("score")).alias("scores"), F.concat("whys", F.array(why)).alias("whys"), "seq",
            "picked", "chosen", "completion", "score", "good", "goes_on",
        ), compression="zstd")
        if log:
            log.add(level.where("picked is not null"), "picked")
            log.add(level.where("chosen"))
        bad = level.where("picked.status <> 'ok'").select(id_col, F.col("picked.error_class").alias("error_class"))
        bad = bad.unionByName(level.where("chosen and score is null").select(id_col, F.coalesce("completion.error_class", F.lit(INJECTION)).alias("error_class")))
        failed = bad if failed is None else failed.unionByName(bad)
        leaves = level.where("good and not goes_on").select(id_col, *state)
        found = leaves if found is None else found.unionByName(leaves)
        front = level.where("goes_on").select(id_col, "content", F.lit(False).alias("blocked"), "at", *state)
        if front.isEmpty():
            break
    failed = failed.groupBy(id_col).agg(F.min("error_class").alias("error_class"))
    best = top_codes(score_paths(found.join(failed, id_col, "left_anti")), id_col, max_codes)
    out = path_columns(best).withColumn("error_class", F.lit(None).cast("string"))
    cols = [id_col, "rank", *[f"code_{k}_{c}" for k in (1, 2, 3) for c in ("id", "name", "confidence")], "confidence", "explanation", "error_class"]
    return out.select(*cols).unionByName(failed, allowMissingColumns=True).select(*cols)
