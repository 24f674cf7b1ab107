"""Connected components by joins: labels and edges stay in Spark, the driver sees only counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, settle, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node that can be reached.

    In every round each node takes the smallest label among its own, its neighbours' and its neighbours' parents'
    (hooking), then the label of its label (pointer jumping), so the rounds grow with the logarithm of a
    chain's length. Each round is written to the shared folder. Hubs and large components are dealt to several
    tasks wherever they are a join's key. No edges give no rows. edges is read several times: a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = settle(hot_keys(both, ["b"]), "hubs")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("comp")), "labels")
    nodes = labels.count()
    while True:
        told = spread_join(both, labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), ["b"], hubs, F.xxhash64("a"))
        near = told.groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_near"))
        hooked = settle(labels.join(near, "node").select("node", "comp", F.least("comp", "_near").alias("_new")), "hooked")
        if hooked.where("_new <> comp").isEmpty():  # no edge between two labels
            discard(hubs, hooked)
            return labels
        # The old root learns of the smaller label too, so that whole trees move at once.
        roots = hooked.groupBy("comp").agg(F.min("_new").alias("_rnew"))
        lifted = spread_join(hooked, roots, ["comp"], hot_keys(hooked, ["comp"], nodes), F.xxhash64("node"))
        lifted = settle(lifted.select("node", F.least("_new", "_rnew").alias("_new")), "lifted")
        up = lifted.select(F.col("node").alias("_new"), F.col("_new").alias("_up"))
        jumped = spread_join(lifted, up, ["_new"], hot_keys(lifted, ["_new"], nodes), F.xxhash64("node"))
        before = labels
        labels = settle(jumped.select("node", F.least("_new", "_up").alias("comp")), "labels")
        discard(before, hooked, lifted)
