"""Density clustering of vectors, per corpus, without a number of clusters: mutual reachability, minimum spanning tree, condensed tree.

All distances inside a corpus are computed once, for pairs of blocks of vectors, each pair in a group of its own and both ways round at once, and reduced
there to the LIST nearest of a point, so no matrix is stored. Products of matrices say which distances may count; only those are computed in full.
The tree grows along these lists. What a list leaves out is no shorter than its last distance, so the cheapest known edge out of a set of points is the
cheapest of all where it is shorter than the last distance of each of the set's points; other edges are not taken. Where no such edge is left, the points that leave
the matter open are compared with all points outside their component. Only the tree's n - 1 edges come together, one corpus in a task, about 24 bytes a record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Vectors of a block, at most, about: a corpus is cut into PARTS blocks at least where each then has LEAST vectors.
BLOCK = 32768
PARTS = 12
LEAST = 1024
#: Rows and columns of a matrix of distances.
TALL, WIDE = 1024, 2048
#: Distances that are computed in full at one time.
FULL = 1 << 17
#: Others that a point's list has.
LIST = 16
#: Known edges of a corpus up to which its tree is grown in one task; more are brought down by rounds of joins.
LOCAL = 2_000_000

_FIRST = -(1 << 63)


# ---------------------------------------------------------------- points in blocks


def _width(points: DataFrame) -> int:
    return 4 if isinstance(points.schema["vec"].dataType.elementType, T.FloatType) else 8


def _packed(points: DataFrame, by: str) -> DataFrame:
    """The points with vec as the bytes of its numbers."""
    width = _width(points)

    def pack(batches):
        for b in batches:
            at = b.schema.get_field_index("vec")
            vec = b.column(at)
            ends = np.concatenate([[0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32) * width
            data = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=f"f{width}")
            yield b.set_column(at, pa.field("vec", pa.binary()), pa.Array.from_buffers(pa.binary(), len(vec), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]))

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(pack, kinds)


def _matrix(col: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of a column of bytes, a row each; all have the same length."""
    a = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if not len(a):
        return np.zeros((0, 0), dtype=kind)
    ends = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1]
    if (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("the vectors of a corpus have different lengths")
    data = np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(data.tobytes(), kind).reshape(len(a), -1)


def _rows_of_bytes(x: np.ndarray) -> pa.Array:
    """A row of numbers as bytes each."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _blocks(n) -> F.Column:
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(PARTS), F.ceil(n / LEAST))).cast("int")


def _pairs(points: DataFrame, by: str) -> tuple[DataFrame, int]:
    """The points of each pair of blocks of a corpus together, a block paired with itself as well, and the number of pairs."""
    sizes = settled(points.groupBy(by).agg(_blocks(F.count("*")).alias("_nb")))
    n = sizes.agg(F.sum(F.expr("CAST(_nb AS BIGINT) * (_nb + 1) DIV 2"))).first()[0] or 0
    placed = points.join(sizes, by).withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return sent.withColumns({"_p": F.least("_blk", "_other"), "_q": F.greatest("_blk", "_other"), "_side": (F.col("_blk") > F.col("_other")).cast("int")}).drop("_nb", "_other", "_blk"), int(n)


def _asked(points: DataFrame, ask: DataFrame, by: str) -> tuple[DataFrame, int]:
    """The points of ask (by, id) in blocks of their own, each together with each block of all points of the corpus, and the number of such pairs."""
    sizes = ask.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_na")).join(points.groupBy(by).agg(F.count("*").alias("_n")), by)
    sizes = settled(sizes.select(by, "_na", F.greatest(F.ceil(F.col("_n") / BLOCK), F.least(F.ceil(64 / F.col("_na")), F.ceil(F.col("_n") / (2 * LEAST)))).cast("int").alias("_nb")))
    n = sizes.agg(F.sum(F.col("_na").cast("long") * F.col("_nb"))).first()[0] or 0
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = points.join(ask.select(by, "id"), [by, "id"], "left_semi").join(sizes, by).withColumns({"_p": block("_na"), "_side": F.lit(0)}).withColumn("_q", every("_nb"))
    y = points.join(sizes, by).withColumns({"_q": block("_nb"), "_side": F.lit(1)}).withColumn("_p", every("_na"))
    return x.unionByName(y).drop("_na", "_nb"), int(n)


# ---------------------------------------------------------------- lists of the nearest


def _full(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows."""
    out = np.empty(len(i))
    for k in range(0, len(i), FULL):
        out[k : k + FULL] = np.sqrt(((x[i[k : k + FULL]] - y[j[k : k + FULL]]) ** 2).sum(axis=1))
    return out


def _some_kth(d: np.ndarray, k: int, axis: int) -> np.ndarray:
    """No less than the k-th smallest of each row (axis 1) or column (axis 0): the k-th of the least of groups."""
    n = d.shape[axis]
    if n < k:
        return np.full(d.shape[1 - axis], np.inf)
    g = max(1, min(16, n // (4 * k)))
    m = n // g
    if axis:
        return np.partition(d[:, : m * g].reshape(len(d), g, m).min(axis=1), k - 1, axis=1)[:, k - 1]
    return np.partition(d[: m * g].reshape(g, m, -1).min(axis=0), k - 1, axis=0)[k - 1]


class _Lists:
    """The k best others of each point of x found so far, by (w, i, j); limit: squares above it do not count any more."""

    def __init__(self, x: dict, y: dict, k: int, slack: float):
        self.x, self.y, self.k, self.slack = x, y, k, slack
        self.limit = np.full(len(x["id"]), np.finfo(float).max)
        self.row, self.to, self.w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        self.fresh = 0

    def add(self, row: np.ndarray, to: np.ndarray) -> None:
        w = np.maximum(np.maximum(_full(self.x["vec"], self.y["vec"], row, to), self.x["core"][row]), self.y["core"][to])
        self.row.append(row)
        self.to.append(to)
        self.w.append(w)
        self.fresh += len(row)
        if self.fresh > max(1 << 20, 4 * self.k * len(self.limit)):
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        row, to, w = np.concatenate(self.row), np.concatenate(self.to), np.concatenate(self.w)
        one, other = self.x["id"][row], self.y["id"][to]
        order = np.lexsort((np.maximum(one, other), np.minimum(one, other), w, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        last = row[place == self.k - 1]
        self.limit[last] = np.minimum(self.limit[last], w[order][place[place < self.k] == self.k - 1] ** 2 + 2 * self.slack)
        self.row, self.to, self.w, self.fresh = [row[place < self.k]], [to[order]], [w[order]], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each point the ids of others and w, in order, with inf where there are fewer than k; and the least w to a point that stands for many."""
        self.settle()
        row, to, w = self.row[0], self.to[0], self.w[0]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ids, far, many = np.zeros((len(self.limit), self.k), np.int64), np.full((len(self.limit), self.k), np.inf), np.full(len(self.limit), np.inf)
        ids[row, place], far[row, place] = self.y["id"][to], w
        np.minimum.at(many, row, np.where(self.y["many"][to], w, np.inf))
        return ids, far, many


def _search(x: dict, y: dict, k: int, both: bool) -> list[_Lists]:
    """Lists of the points of x among those of y in other components; with both also the other way round. x may be y."""
    xx, yy = (x["vec"] ** 2).sum(axis=1), (y["vec"] ** 2).sum(axis=1)
    slack = 1e-11 * float(xx.max() + yy.max())  # more than the products can be wrong by
    left = np.hstack([-2 * x["vec"], xx[:, None], np.ones((len(xx), 1))])
    right = np.hstack([y["vec"], np.ones((len(yy), 1)), yy[:, None]])
    cored = x["core"].any() or y["core"].any()
    mine, theirs = _Lists(x, y, k, slack), _Lists(y, x, k, slack) if both and x is not y else None
    for s, a in enumerate(range(0, len(xx), TALL), 1):
        rows = slice(a, a + TALL)
        for b in range(0, len(yy), WIDE):
            cols = slice(b, b + WIDE)
            d = left[rows] @ right[cols].T
            if cored:
                np.maximum(d, x["core"][rows, None] ** 2, out=d)
                np.maximum(d, y["core"][None, cols] ** 2, out=d)
            if not both or x is y and a < b + WIDE and b < a + TALL:
                d[x["comp"][rows, None] == y["comp"][None, cols]] = np.inf
            for lists, part, axis in ((mine, rows, 1), (theirs, cols, 0)):
                if lists is None:
                    continue
                if axis and b == 0 or not axis and a == 0 or lists.limit[part].max() > 1e300:
                    lists.limit[part] = np.minimum(lists.limit[part], _some_kth(d, k, axis) + 2 * slack)
                at = np.flatnonzero(d <= (lists.limit[part][:, None] if axis else lists.limit[part]))
                i, j = np.divmod(at, d.shape[1])
                lists.add(*((i + a, j + b) if axis else (j + b, i + a)))
        if theirs is not None and s & (s - 1) == 0:
            theirs.settle()
    return [mine] if theirs is None else [mine, theirs]


def _nearest(cells: DataFrame, n_cells: int, by: str, k: int, by_rank: bool, wide: int, m: int = 0) -> DataFrame:
    """(by, id, to, w, core, bw, bi, bj) from the points of pairs of blocks (by, _p, _q, _side, id, vec, core, comp, many): the k best others of each point by (w, i, j), ids and
    w as bytes; all edges that are not listed come after (bw, bi, bj): by_rank the last one listed, else any with its w. core: the w of the place m, if m is given."""
    kind = f"f{wide}"

    def cell(table):
        side = table["_side"].to_numpy()
        vec = _matrix(table["vec"], kind).astype(np.float64)
        x = {c: table[c].to_numpy() for c in ("id", "core", "comp", "many")} | {"vec": vec}
        one, other = [{c: v[side == s] for c, v in x.items()} for s in (0, 1)]
        own = not by_rank and table["_p"][0].as_py() == table["_q"][0].as_py()
        found = []
        if len(one["id"]) and (own or len(other["id"])):
            found = [(q.x["id"], *q.rows()) for q in _search(one, one if own else other, k, not by_rank)]
        name, n = table[by][0].as_py(), sum(len(f[0]) for f in found)
        join = lambda c, empty: np.concatenate([*(f[c] for f in found), empty])
        ids, far = join(1, np.zeros((0, k), np.int64)), join(2, np.zeros((0, k)))
        return pa.table([pa.array([name] * n, pa.string()), pa.array(join(0, np.zeros(0, np.int64))), _rows_of_bytes(ids), _rows_of_bytes(far), pa.array(join(3, np.zeros(0)))], names=[by, "id", "to", "w", "many"])

    def merge(table):
        ids = table["id"].to_numpy()
        mine, row = np.unique(ids, return_inverse=True)
        to, w = _matrix(table["to"], "i8").ravel(), _matrix(table["w"], "f8").ravel()
        row = np.repeat(row, k)
        some = np.isfinite(w)
        row, to, w = row[some], to[some], w[some]
        i, j = np.minimum(mine[row], to), np.maximum(mine[row], to)
        order = np.lexsort((j, i, w, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, place = order[place < k], place[place < k]
        all_to, all_w = np.zeros((len(mine), k), np.int64), np.full((len(mine), k), np.inf)
        all_to[row[order], place], all_w[row[order], place] = to[order], w[order]
        core = all_w[:, m - 2].copy() if m else np.full(len(mine), np.inf)
        np.minimum.at(core, np.unique(ids, return_inverse=True)[1], table["many"].to_numpy() if m else np.inf)
        bi, bj = [f(mine, all_to[:, -1]) if by_rank else np.full(len(mine), _FIRST) for f in (np.minimum, np.maximum)]
        cols = [pa.array([table[by][0].as_py()] * len(mine), pa.string()), pa.array(mine), _rows_of_bytes(all_to), _rows_of_bytes(all_w), pa.array(core, mask=~np.isfinite(core)), pa.array(all_w[:, -1]), pa.array(bi), pa.array(bj)]
        return pa.table(cols, names=[by, "id", "to", "w", "core", "bw", "bi", "bj"])

    cells = cells.select(by, "_p", "_q", "_side", "id", "vec", "core", "comp", "many").repartition(max(n_cells, 1) if n_cells < 4096 else 4096, by, "_p", "_q")
    found = cells.groupBy(by, "_p", "_q").applyInArrow(cell, f"`{by}` string, id long, to binary, w binary, many double")
    found = found.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(max(8, min(n_cells, 4096)))))
    return found.groupBy(by, "_part").applyInArrow(merge, f"`{by}` string, id long, to binary, w binary, core double, bw double, bi long, bj long")


def _listed(lists: DataFrame, by: str) -> DataFrame:
    """(by, id, to, w), a row for each other of a list."""

    def rows(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            to, w = _matrix(t["to"], "i8"), _matrix(t["w"], "f8")
            if not len(t):
                continue
            at, k = np.nonzero(np.isfinite(w))
            yield pa.RecordBatch.from_arrays([t[by].combine_chunks().take(pa.array(at)), pa.array(t["id"].to_numpy()[at]), pa.array(to[at, k]), pa.array(w[at, k])], names=[by, "id", "to", "w"])

    return lists.select(by, "id", "to", "w").mapInArrow(rows, f"`{by}` string, id long, to long, w double")


def _first_lists(points: DataFrame, by: str, k: int, m: int) -> DataFrame:
    """The k nearest others of each point by distance, and core: that of the m-th nearest, the point itself counted. points: (by, id, vec), and many where a point stands for many."""
    packed = _packed(points, by).withColumns({"core": F.lit(0.0), "comp": F.col("id")} | ({} if "many" in points.columns else {"many": F.lit(False)}))
    cells, n = _pairs(packed, by)
    return _nearest(cells, n, by, k, False, _width(points), m)


def core_distances(points: DataFrame, by: str, m: int) -> DataFrame:
    """(by, id, core): the distance to the m-th nearest point, the point itself counted."""
    return _first_lists(points, by, m - 1, m).select(by, "id", "core")


# ---------------------------------------------------------------- the tree


def _join_comps(edges: DataFrame, bounds: DataFrame, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: each component whose cheapest known edge out is certain takes it. (new edges of the tree, comp and up: where each component goes, whether any does)."""
    both = edges.select(by, F.col("ci").alias("comp"), F.col("cj").alias("to"), "w", "i", "j").unionByName(edges.select(by, F.col("cj").alias("comp"), F.col("ci").alias("to"), "w", "i", "j"))
    best = both.groupBy(by, "comp").agg(F.min(F.struct("w", "i", "j", "to")).alias("e"))
    sure = bounds.join(best, [by, "comp"], "left").withColumn("sure", F.col("e").isNotNull() & F.coalesce(F.struct("e.w", "e.i", "e.j") <= F.struct(F.col("bw").alias("w"), F.col("bi").alias("i"), F.col("bj").alias("j")), F.lit(False)))
    sure = settled(sure.select(by, "comp", "e", "sure"))
    fresh = sure.where("sure").select(by, "e.w", "e.i", "e.j").distinct()
    # Each component points to the one its edge leads to; the smaller of two that point to each other is a root, and so is one without an edge.
    up = sure.select(by, "comp", F.when(F.col("sure"), F.col("e.to")).otherwise(F.col("comp")).alias("up"))
    back = up.select(by, F.col("comp").alias("up"), F.col("up").alias("back"))
    up = settled(up.join(back, [by, "up"]).select(by, "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")))
    while True:
        nxt = settled(up.join(up.select(by, F.col("comp").alias("up"), F.col("up").alias("up2")), [by, "up"]).select(by, "comp", "up", "up2"))
        up = nxt.select(by, "comp", F.col("up2").alias("up"))
        if nxt.where("up <> up2").isEmpty():
            return fresh, up, sure


def _grow(e: pa.Table, b: pa.Table, by: str) -> pa.Table:
    """The tree of one corpus as far as it is certain: kind 0: its edges (w, i, j); kind 1: components i and the smallest component j that each is joined with."""
    comps = np.sort(b["comp"].to_numpy())
    at = np.argsort(b["comp"].to_numpy())
    bound = list(zip(b["bw"].to_numpy()[at].tolist(), b["bi"].to_numpy()[at].tolist(), b["bj"].to_numpy()[at].tolist(), strict=True))
    w, i, j = (e[c].to_numpy() for c in ("w", "i", "j"))
    order = np.lexsort((j, i, w))
    w, i, j = w[order], i[order], j[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    w, i, j, order = w[new], i[new], j[new], order[new]
    ci, cj = (np.searchsorted(comps, e[c].to_numpy()[order]) for c in ("ci", "cj"))
    known, joined = list(range(len(comps))), list(range(len(comps)))

    def find(root, x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    taken = []
    for k, (x, y) in enumerate(zip(ci.tolist(), cj.tolist(), strict=True)):
        p, q = find(known, x), find(known, y)
        if p == q:
            continue
        if (float(w[k]), int(i[k]), int(j[k])) <= max(bound[p], bound[q]):
            taken.append(k)
            p2, q2 = find(joined, x), find(joined, y)
            joined[max(p2, q2)] = min(p2, q2)
        known[max(p, q)] = min(p, q)
        bound[min(p, q)] = min(bound[p], bound[q])
    up = comps[[find(joined, x) for x in range(len(comps))]]
    name = (b if len(b) else e)[by][0].as_py()
    kind = np.repeat(np.array([0, 1], np.int32), [len(taken), len(comps)])
    cols = [kind, np.concatenate([w[taken], np.zeros(len(comps))]), np.concatenate([i[taken], comps]), np.concatenate([j[taken], up])]
    return pa.table([pa.array([name] * len(kind), pa.string()), *map(pa.array, cols)], names=[by, "kind", "w", "i", "j"])


def spanning_tree(points: DataFrame, core: DataFrame, by: str, lists: DataFrame | None = None) -> DataFrame:
    """(by, w, i, j): the minimum spanning tree of mutual reachability; ties by (w, i, j), so it is one tree. lists: what _first_lists gives for the points, if known."""
    wide = _width(points)
    packed = settled(_packed(points.select(by, "id", "vec"), by).join(core.select(by, "id", "core"), [by, "id"]).withColumn("many", F.lit(False)))
    bound = "bw double, bi long, bj long"
    if lists is None:
        state = packed.select(by, "id", F.col("id").alias("comp"), F.lit(float("-inf")).alias("bw"), F.lit(_FIRST).alias("bi"), F.lit(_FIRST).alias("bj"))
        edges = points.sparkSession.createDataFrame([], f"`{by}` string, ci long, cj long, w double, i long, j long")
    else:
        state = lists.select(by, "id", F.col("id").alias("comp"), "bw", "bi", "bj")
        one, other = core.select(by, "id", F.col("core").alias("c1")), core.select(by, F.col("id").alias("to"), F.col("core").alias("c2"))
        known = _listed(lists, by).join(one, [by, "id"]).join(other, [by, "to"])
        known = known.select(by, F.greatest("w", "c1", "c2").alias("w"), F.least("id", "to").alias("i"), F.greatest("id", "to").alias("j"))
        edges = settled(known.select(by, F.col("i").alias("ci"), F.col("j").alias("cj"), "w", "i", "j"))
    state = settled(state)
    comps_of = lambda s: s.groupBy(by, "comp").agg(F.min(F.struct("bw", "bi", "bj")).alias("b")).select(by, "comp", "b.*")
    tree = []

    def follow(up):
        """Points and edges after components have gone where up says."""
        nonlocal state, edges
        state = settled(state.join(up, [by, "comp"], "left").select(by, "id", F.coalesce("up", "comp").alias("comp"), "bw", "bi", "bj"))
        ends = edges
        for c in ("ci", "cj"):
            ends = ends.join(up.select(by, F.col("comp").alias(c), "up"), [by, c], "left").withColumn(c, F.coalesce("up", c)).drop("up")
        ends = ends.where("ci <> cj").groupBy(by, F.least("ci", "cj").alias("x"), F.greatest("ci", "cj").alias("y")).agg(F.min(F.struct("w", "i", "j")).alias("e"))
        edges = settled(ends.select(by, F.col("x").alias("ci"), F.col("y").alias("cj"), "e.*"))

    while True:
        while not edges.groupBy(by).count().where(F.col("count") > LOCAL).isEmpty():
            fresh, up, sure = _join_comps(edges, comps_of(state), by)
            if sure.where("sure").isEmpty():
                break
            tree.append(fresh)
            follow(up)
        if not edges.isEmpty():
            here = edges.groupBy(by).count().where(F.col("count") <= LOCAL).select(by)
            e = edges.join(here, by, "left_semi").select(by, "ci", "cj", "w", "i", "j")
            b = comps_of(state).join(here, by, "left_semi").select(by, "comp", "bw", "bi", "bj")
            got = settled(e.groupBy(by).cogroup(b.groupBy(by)).applyInArrow(lambda x, y: _grow(x, y, by), f"`{by}` string, kind int, w double, i long, j long"))
            tree.append(got.where("kind = 0").select(by, "w", "i", "j"))
            follow(got.where("kind = 1 AND i <> j").select(by, F.col("i").alias("comp"), F.col("j").alias("up")))
        # What is left open: points with edges that are not listed and might be cheaper than the cheapest known one out of their component.
        still = state.groupBy(by).agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select(by)
        open_ = state.join(still, by, "left_semi")
        both = edges.select(by, F.col("ci").alias("comp"), "w", "i", "j").unionByName(edges.select(by, F.col("cj").alias("comp"), "w", "i", "j"))
        best = both.groupBy(by, "comp").agg(F.min(F.struct("w", "i", "j")).alias("e"))
        ask = open_.join(best, [by, "comp"], "left").where(F.col("e").isNull() | (F.struct(F.col("bw").alias("w"), F.col("bi").alias("i"), F.col("bj").alias("j")) < F.col("e"))).select(by, "id", "comp")
        ask = settled(ask)
        if ask.isEmpty():
            break
        # All components but the one with the most such points ask; then each that asked knows its edge.
        most = ask.groupBy(by, "comp").count().groupBy(by).agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("n")).select(by, F.col("m.comp").alias("_m"), "n")
        ask = settled(ask.join(most, by).where("n = 1 OR comp <> _m").select(by, "id"))
        cells, n = _asked(packed.join(open_.select(by, "id", "comp"), [by, "id"]), ask, by)
        more = settled(_nearest(cells, n, by, LIST, True, wide))
        found = _listed(more, by).select(by, F.least("id", "to").alias("i"), F.greatest("id", "to").alias("j"), "w")
        comp = lambda c, e: state.select(by, F.col("id").alias(c), F.col("comp").alias(e))
        if found.isEmpty():
            raise ValueError("vectors are so far apart that squares of distances are no numbers")
        found = found.join(comp("i", "ci"), [by, "i"]).join(comp("j", "cj"), [by, "j"]).select(by, "ci", "cj", "w", "i", "j")
        edges = settled(edges.select(by, "ci", "cj", "w", "i", "j").unionByName(found))
        new = more.select(by, "id", *[F.col(c).alias(f"_{c}") for c in ("bw", "bi", "bj")])
        took = F.col("_bw").isNotNull()
        state = settled(state.join(new, [by, "id"], "left").select(by, "id", "comp", *[F.when(took, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("bw", "bi", "bj")]))
    out = tree[0] if tree else edges.select(by, "w", "i", "j")
    for t in tree[1:]:
        out = out.unionByName(t)
    return out


# ---------------------------------------------------------------- clusters


def condensed_labels(w: np.ndarray, i: np.ndarray, j: np.ndarray, m: int) -> dict[int, int]:
    """Labels of the points of one tree: clusters of m points or more with the largest excess of mass, the whole never one; the rest -1."""
    ids = np.unique(np.concatenate([i, j]))
    n, index = len(ids), {v: k for k, v in enumerate(ids.tolist())}
    root = list(range(2 * n))
    top = {k: k for k in range(n)}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kids, height, size = {}, {}, [1] * (2 * n)
    nxt = n
    for k in np.lexsort((j, i, w)).tolist():
        a, b = find(index[int(i[k])]), find(index[int(j[k])])
        kids[nxt], height[nxt], size[nxt] = (top[a], top[b]), float(w[k]), size[top[a]] + size[top[b]]
        root[b] = a
        top[a] = nxt
        nxt += 1
    # From the whole downward: a split into two parts of m or more makes two clusters, else points fall out of one.
    lam = lambda h: np.inf if h <= 0 else 1.0 / h
    birth, parent, points, mass = {0: 0.0}, {0: None}, {0: []}, {0: 0.0}
    stack, count = [(nxt - 1, 0)], 1

    def leaves(x):
        todo, out = [x], []
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo.extend(kids[y])
        return out

    while stack:
        node, c = stack.pop()
        at = lam(height[node])
        big = [x for x in kids[node] if size[x] >= m]
        gone = sum(size[x] for x in kids[node]) if len(big) == 2 else sum(size[x] for x in kids[node] if size[x] < m)
        if gone:
            mass[c] += gone * (at - birth[c] if np.isfinite(at) else 1e12)
        for x in kids[node]:
            if len(big) == 2:
                birth[count], parent[count], points[count], mass[count] = at, c, [], 0.0
                stack.append((x, count)) if x >= n else points[count].append(x)
                count += 1
            elif size[x] >= m and x >= n:
                stack.append((x, c))
            else:
                points[c] += leaves(x)
    inner = {}
    for c in range(1, count):
        inner.setdefault(parent[c], []).append(c)
    chosen, best = set(), {}
    for c in range(count - 1, 0, -1):
        below = sum(best[x] for x in inner.get(c, ()))
        best[c] = max(mass[c], below)
        if mass[c] >= below:
            chosen.add(c)
    labels, final = {}, []

    def members(c):
        below, out = [c], []
        while below:
            x = below.pop()
            out += points[x]
            below += inner.get(x, ())
        return out

    todo = list(inner.get(0, ()))
    while todo:
        c = todo.pop()
        if c in chosen:
            final.append(sorted(members(c)))
        else:
            todo += inner.get(c, ())
    for k, group in enumerate(sorted(final)):
        labels |= {int(ids[p]): k for p in group}
    return {int(v): labels.get(int(v), -1) for v in ids}


def _copies(points: DataFrame, by: str, m: int) -> DataFrame:
    """(by, id, rep) of vectors that m points or more of a corpus share; rep is the smallest of these points."""
    marked = points.withColumn("_h", F.xxhash64("vec"))
    often = marked.groupBy(by, "_h").count().where(F.col("count") >= m).select(by, "_h")
    marked = settled(marked.join(often, [by, "_h"], "left_semi"))
    reps = marked.groupBy(by, "_h", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("_n")).where(F.col("_n") >= m).drop("_n")
    return settled(marked.join(reps, [by, "_h", "vec"]).select(by, "id", "rep"))


def cluster_vectors(df: DataFrame, by: str = "corpus_id", id_col: str = "pos", vec: str = "embedding", min_cluster_size: int = 5) -> DataFrame:
    """(by, id, label): label -1 is noise; clusters are numbered by their smallest id. Corpora of fewer than min_cluster_size rows are noise,
    and so are rows without a vector of finite numbers.

    Exact: all distances inside a corpus are computed, euclidean. Of min_cluster_size or more equal vectors one stands for all: it is 0 from the others, which
    hang on it in the tree.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size is 2 or more")
    kind = "array<float>" if df.schema[vec].dataType == T.ArrayType(T.FloatType(), df.schema[vec].dataType.containsNull) else "array<double>"
    points = settled(df.select(F.col(by).cast("string").alias(by), F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind).alias("vec")))
    usable = points.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    enough = usable.groupBy(by).count().where(F.col("count") >= min_cluster_size).select(by)
    large = usable.join(enough, by, "left_semi")
    copies = _copies(large, by, min_cluster_size)
    if copies.isEmpty():
        large = large.withColumn("many", F.lit(False))
    else:
        rest = large.join(copies.where("id <> rep").select(by, "id"), [by, "id"], "left_anti")
        large = rest.join(copies.where("id = rep").select(by, "id", F.lit(True).alias("_rep")), [by, "id"], "left").select(by, "id", "vec", F.coalesce("_rep", F.lit(False)).alias("many"))
    large = settled(large)
    lists = settled(_first_lists(large, by, max(LIST, min_cluster_size - 1), min_cluster_size))
    core = large.join(lists.select(by, "id", "core"), [by, "id"]).select(by, "id", F.when(F.col("many"), 0.0).otherwise(F.col("core")).alias("core"))
    tree = spanning_tree(large, core, by, lists).unionByName(copies.where("id <> rep").select(by, F.lit(0.0).alias("w"), F.col("rep").alias("i"), F.col("id").alias("j")))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        got = condensed_labels(pdf["w"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy(), min_cluster_size)
        return pd.DataFrame({by: pdf[by].iloc[0], "id": list(got), "label": list(got.values())})

    labels = tree.groupBy(by).applyInPandas(label, f"`{by}` string, id long, label int")
    out = points.select(by, "id").join(labels, [by, "id"], "left")
    return out.select(by, F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))
