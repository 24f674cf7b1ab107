"""Near duplicates by MinHash with tensored banding.

A document gets two small collections of half keys: LEFT and RIGHT of ROWS minimum hashes each.
Each pair of one of either makes the key of a table, so LEFT x RIGHT tables cost ROWS (LEFT + RIGHT)
minimum hashes. Two sets of similarity s meet in a table with probability
(1 - (1 - s^3)^LEFT) (1 - (1 - s^3)^RIGHT): 0.998 at 0.8, 0.057 at 0.3, 0.0001 at 0.1.

Texts with equal sets are one class from the start. Table keys are range-partitioned and sorted with their
classes, so a key of any size may lie in several partitions; the classes of a key are tied to its first one.
Each class is compared with the few that it is tied to most often. Then the classes of the keys that are not yet one
component are looked at: those that share a left half key and are not connected meet in cells of
bounded size, blocks of the rest against each other and against blocks of the key's largest component, and pairs that share a right half key too
(so a table) are compared, each at the first left half key it shares. Ties are never closed before a comparison has confirmed them, no pairs are
emitted but the few with leaders and the links found, and all comparisons are on the full sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, keep_rows, mix, settle, span_hashes, spread_join, table, text_hash, word_spans
from .graph import components

WORDS = 5
PERCENT = 80
LEFT, RIGHT, ROWS = 10, 10, 3
#: So many of the classes that a class is tied to are compared with it before the cells.
LEADERS = 2
#: Classes of a block, and sets that a cell holds at a time.
BLOCK = 250
HELD = 400
#: A cell whose sets have fewer members in all holds them all.
SETS = 4_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 2_000_000

_RNG = np.random.default_rng(77)
_HASHES = ROWS * (LEFT + RIGHT)
_XOR = _RNG.integers(0, 2**63, _HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams; with fewer words, of the whole sequence."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < CHUNK):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        data = np.frombuffer(b"\n".join(part).lower(), dtype=np.uint8)  # bytes.lower() changes A-Z only
        starts, ends = word_spans(data)
        h = span_hashes(data, starts, ends)
        limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in part]))
        begin = 0
        for end in limits.tolist():
            mine = h[begin:end]
            k = min(words, len(mine))
            if k:
                s = np.zeros(len(mine) - k + 1, dtype=np.uint64)
                for j in range(k):
                    s = mix(s * _ROT + mine[j : len(mine) - k + 1 + j])
                out.append(np.unique(s ^ np.uint64(k)))
            else:
                out.append(mine)
            begin = end
    return out


def half_keys(s: np.ndarray) -> np.ndarray:
    """LEFT + RIGHT half keys of a set."""
    lows = np.full(_HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(s), 4096):
        lows = np.minimum(lows, ((s[None, k : k + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    rows = lows.reshape(LEFT + RIGHT, ROWS)
    out = rows[:, 0]
    for k in range(1, ROWS):
        out = mix(out) + rows[:, k]
    return mix(out)


def set_node(s: np.ndarray) -> int:
    """A 64-bit digest of a set, the name of its class."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _signed(words: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets([t or b"" for t in b.column("_text").to_pylist()], words)
            nodes = [set_node(s) if len(s) else None for s in sets]
            keys = [half_keys(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["_id", "_th", "n", "node", "half"])

    return run


_TABLE = mix(np.arange(1, LEFT * RIGHT + 1, dtype=np.uint64)).reshape(LEFT, RIGHT)


def _table_keys(batches):
    for b in batches:
        half = np.frombuffer(b"".join(b.column("half").to_pylist()), dtype=np.uint64).reshape(-1, LEFT + RIGHT)
        nodes = b.column("node").to_numpy()
        for k in range(0, len(half), 2000):
            h = half[k : k + 2000]
            key = mix(h[:, :LEFT, None] * _ROT + h[:, None, LEFT:] + _TABLE[None]).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(nodes[k : k + 2000], LEFT * RIGHT))], names=["key", "node"])


def _tie(batches):
    """kind 0: a class and the first one of its key in this partition; 1 and 2: the partition's first and last key with their first class."""
    names = ["kind", "key", "a", "b"]
    head = last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        if last is not None and key[0] == last[0]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, node[at], last[1] if last is not None else 0)
        if head is None:
            head = (key[0], node[0])
        last = (key[-1], first[-1])
        take = np.flatnonzero(first != node)
        if len(take):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(take), dtype=np.int32)), pa.array(key[take]), pa.array(first[take]), pa.array(node[take])], names=names)
    if last is not None:
        ends = [np.array([head[k], last[k]], dtype=np.int64) for k in (0, 1, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), *[pa.array(x) for x in ends]], names=names)


def _packed(words: int):
    """Texts of the rows that are what their class is named for, deflated, with the size of their sets."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            want, half = b.column("node"), b.column("half")
            sizes = b.column("n")
            yield pa.RecordBatch.from_arrays([want, sizes, half, pa.array([zlib.compress(t.lower(), 1) for t in texts], pa.binary())], names=["node", "n", "half", "packed"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(words: int, percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for k in range(0, b.num_rows, 500):
                xs, ys = (shingle_sets([zlib.decompress(t) for t in b.column(c).slice(k, 500).to_pylist()], words) for c in ("_x", "_y"))
                keep += [_similar(x, y, percent) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "ok"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the full comparison confirms; where the sizes are too far apart none is needed."""
    x, y = (texts.select(F.col("node").alias(c), F.col("n").alias(n), F.col("packed").alias(p)) for c, n, p in (("a", "_na", "_x"), ("b", "_nb", "_y")))
    both = spread_join(pairs.join(y, "b"), x, ["a"], hot_keys(pairs, ["a"]), F.col("b")).where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
    return both.select("a", "b", "_x", "_y").mapInArrow(_confirm(words, percent), "a long, b long, ok boolean").where("ok").select("a", "b")


def _partners(i: int, cell: dict, label: np.ndarray, at: int, percent: int) -> np.ndarray:
    """Classes of a cell that share a table with class i and are to be compared with it here, the most alike first.

    A pair that shares several left half keys is compared at the first of them alone.
    """
    n, half = cell["n"], cell["half"]
    order = np.flatnonzero((label != label[i]) & ((np.arange(len(label)) < i) | cell["large"]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
    if not len(order):
        return order
    same = half[order] == half[i]
    here = (same[:, :LEFT].argmax(axis=1) == at) & same[:, LEFT:].any(axis=1)
    return order[here][np.argsort(-same[here].sum(axis=1), kind="stable")]


_LEFT_SALT = _TABLE[:, 0]


def _left_keys(batches):
    """For each class the keys of its left half keys."""
    for b in batches:
        half = np.frombuffer(b"".join(b.column("half").to_pylist()), dtype=np.uint64).reshape(-1, LEFT + RIGHT)
        keys = mix(half[:, :LEFT] + _LEFT_SALT).reshape(-1).view(np.int64)
        cols = [np.repeat(b.column(c).to_numpy(), LEFT) for c in ("node", "comp")]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, cols)], names=["key", "node", "comp"])


def _read_cell(rows: dict[str, list]) -> tuple[dict, np.ndarray, int]:
    half = np.frombuffer(b"".join(rows["half"]), dtype=np.uint64).reshape(-1, LEFT + RIGHT)
    _, label = np.unique(np.array(rows["comp"], dtype=np.int64), return_inverse=True)
    return {"half": half, "large": np.array(rows["large"], dtype=bool), "n": np.array(rows["n"])}, label, int(np.flatnonzero(mix(half[0, :LEFT] + _LEFT_SALT).view(np.int64) == rows["key"][0])[0])


def _met(rows: dict[str, list], percent: int) -> np.ndarray:
    """Marks the classes of a cell that are to be compared with any other there."""
    cell, label, at = _read_cell(rows)
    out = np.zeros(len(label), dtype=bool)
    for i in np.flatnonzero(~cell["large"]).tolist():
        found = _partners(i, cell, label, at, percent)
        if len(found):
            out[i] = True
            out[found] = True
    return out


def _link_cell(rows: dict[str, list], words: int, percent: int) -> list[tuple[int, int]]:
    """Links between classes of one cell that are not yet connected, one of each component's at most."""
    cell, label, at = _read_cell(rows)
    held: dict[int, np.ndarray] = {}
    packed, nodes, out = rows["packed"], rows["node"], []
    if cell["n"].sum() < SETS:
        held.update(enumerate(shingle_sets([zlib.decompress(x) for x in packed], words)))

    def full(k: int) -> np.ndarray:
        if k not in held:
            while len(held) >= HELD:
                del held[next(iter(held))]
            held[k] = shingle_sets([zlib.decompress(packed[k])], words)[0]
        return held[k]

    for i in np.flatnonzero(~cell["large"]).tolist():
        # The most alike first: a link to one class of a component makes the others needless.
        for j in _partners(i, cell, label, at, percent).tolist():
            if label[j] != label[i] and _similar(full(i), full(j), percent):
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def _by_cell(batches, columns: tuple[str, ...]):
    """The rows of each cell of a sorted partition, as lists by column."""
    cell, held = None, {c: [] for c in columns}
    for b in batches:
        cells = b.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
        cols = {c: b.column(c).to_pylist() for c in columns}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if cells[lo] != cell:
                if held[columns[0]]:
                    yield cell, held
                cell, held = cells[lo], {c: [] for c in columns}
            for c in columns:
                held[c] += cols[c][lo:hi]
    if held[columns[0]]:
        yield cell, held


_CELL = ("node", "comp", "large", "key", "n", "half")


def _met_cells(percent: int):
    def run(batches):
        for cell, rows in _by_cell(batches, _CELL):
            k = np.flatnonzero(_met(rows, percent)).tolist()
            if k:
                cols = [pa.array([rows[c][x] for x in k], t) for c, t in (("node", pa.int64()), ("comp", pa.int64()), ("large", pa.bool_()), ("key", pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(k), pa.int64()), *cols], names=["cell", "node", "comp", "large", "key"])

    return run


def _link_cells(words: int, percent: int):
    def run(batches):
        for _, rows in _by_cell(batches, (*_CELL, "packed")):
            out = _link_cell(rows, words, percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def _open_members(members: DataFrame, comps: DataFrame, compared: DataFrame, halves: DataFrame) -> DataFrame:
    """(key, node, comp): of the classes that share a table with one they are not connected to (but for pairs that were compared), those that share a left half key with such a one; key stands for it."""
    placed = settle(members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "members")
    keys = placed.groupBy("key").agg(F.count("*").alias("_c"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("node").alias("a"), F.max("node").alias("b")).where("_lo <> _hi")
    done = compared.select("a", "b").withColumn("_c", F.lit(2).cast("long"))
    keys = settle(keys.join(done, ["a", "b", "_c"], "left_anti").select("key"), "open")
    nodes = spread_join(placed, keys, ["key"], hot_keys(placed, ["key"]), F.xxhash64("node"), "left_semi").select("node", "comp").distinct()
    left = settle(nodes.join(halves, "node").select("node", "comp", "half").mapInArrow(_left_keys, "key long, node long, comp long"), "left")
    discard(placed, keys)
    keys = left.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key")
    return spread_join(left, keys, ["key"], hot_keys(left, ["key"]), F.xxhash64("node"), "left_semi")


def _cells(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, node, comp, large, key): the classes of each key in cells of 2 block classes at most, about.

    A key of up to block classes is one cell. Of a larger one the largest component is compared with the rest only.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"))
    sizes = sizes.select("key", F.col("top.comp").alias("_top"), F.ceil((F.col("n") - F.col("top.c")) / block).cast("int").alias("nr"), F.ceil(F.col("top.c") / block).cast("int").alias("ng"), (F.col("n") <= block).alias("one"))
    p = spread_join(members, sizes, ["key"], hot_keys(members, ["key"]), F.xxhash64("node")).withColumn("large", F.col("comp") == F.col("_top"))
    p = p.withColumn("blk", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("ng")).otherwise(F.col("nr"))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    rest = F.concat(F.transform(to(F.col("nr")), lambda j: F.struct(F.lit(0).alias("t"), F.least("blk", j).alias("i"), F.greatest("blk", j).alias("j"))), F.transform(to(F.col("ng")), lambda j: F.struct(F.lit(1).alias("t"), F.col("blk").alias("i"), j.alias("j"))))
    top = F.transform(to(F.col("nr")), lambda i: F.struct(F.lit(1).alias("t"), i.alias("i"), F.col("blk").alias("j")))
    alone = F.array(F.struct(F.lit(2).alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    where = F.when(F.col("one"), alone).when(F.col("large"), top).otherwise(rest)
    return p.select("node", "comp", "large", "key", F.explode(where).alias("w")).select("node", "comp", "large", "key", F.xxhash64("key", "w.t", "w.i", "w.j").alias("cell"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, with_hash: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id = component_id).

    A text's set is its distinct n-grams of words, A-Z lower-cased; texts without words (null, empty) have an empty set and are
    linked with nothing. component_id is the smallest id that can be reached. Rows with equal sets are always linked, repeated rows
    too (they are all kept, or none). A null id is larger than any other: such a row's component_id is the smallest id of its
    component, null if it has none, and kept is false unless null. Very long texts are compared whole. Other columns of any name are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_hash(text_col).alias("_th"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    signed = settle(rows.mapInArrow(_signed(words), "_id long, _th long, n long, node long, half binary"), "signed")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_th")).alias("_rep")
    classes = settle(signed.where("node is not null").groupBy("node").agg(first, F.first("n").alias("n"), F.first("half").alias("half")), "classes")
    keys = classes.select("node", "half").mapInArrow(_table_keys, "key long, node long")
    keys = keys.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    tied = settle(keys.mapInArrow(_tie, "kind int, key long, a long, b long"), "tied")
    # A key that goes on in the next partition: two rows for each partition at most.
    ends = tied.where("kind > 0").groupBy("key").agg(F.min("a").alias("a"), F.collect_set("a").alias("_all")).where(F.size("_all") > 1).select("key", "a", F.explode("_all").alias("b")).where("a <> b")
    tied = tied.where("kind = 0").select("key", "a", "b").unionByName(ends)
    ties = settle(tied.groupBy("a", "b").agg(F.count("*").alias("t")), "ties")
    members = tied.select("key", F.col("b").alias("node")).unionByName(tied.select("key", F.col("a").alias("node"))).distinct()

    # A row for each class that shares a table: of rows that have the representative's id and text one is enough.
    need = ties.select(F.col("a").alias("node")).unionByName(ties.select(F.col("b").alias("node"))).distinct().join(classes, "node").select("node", "n", "half", F.col("_rep._id").alias("_id"), F.col("_rep._th").alias("_th"))
    texts = spread_join(rows, need, ["_id", "_th"], hot_keys(signed, ["_id", "_th"]), F.monotonically_increasing_id())
    texts = settle(texts.select("node", "n", "half", "_text").mapInArrow(_packed(words), "node long, n long, half binary, packed binary").dropDuplicates(["node"]), "texts")

    # Each class with the LEADERS it is tied to most often; a class has at most one row a table here.
    best = ties.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("t", "a")), asc=False), 1, LEADERS).alias("_l"))
    compared = settle(best.select("b", F.explode("_l.a").alias("a")).select("a", "b"), "compared")
    links = settle(_verified(compared, texts, words, percent), "links")
    comps = components(links)
    open_ = settle(_open_members(members, comps, compared, texts.select("node", "half")), "open-members")
    if not open_.isEmpty():
        placed = lambda cells, *more: cells.join(texts.select("node", "n", "half", *more), "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", *_CELL, *more)
        # First without texts: who meets whom. A class takes its text only to cells where it is compared.
        met = settle(placed(_cells(open_)).mapInArrow(_met_cells(percent), "cell long, node long, comp long, large boolean, key long"), "met")
        more = settle(placed(met, "packed").mapInArrow(_link_cells(words, percent), "a long, b long"), "links")
        if not more.isEmpty():
            comps = components(links.unionByName(more))

    named = settle(classes.select("node", F.col("_rep._id").alias("_rep")).join(comps, "node", "left").select("node", "_rep", F.coalesce("comp", "node").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("_rep").alias("_least"))
    least = settle(spread_join(named, least, ["comp"], hot_keys(named, ["comp"]), F.xxhash64("node")).select("node", "_least"), "least")
    marked = signed.select("_id", "_th", "n", "node")
    out = spread_join(marked, least, ["node"], hot_keys(marked, ["node"]), F.monotonically_increasing_id(), "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), *(["_th"] if with_hash else []))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: those whose id is the smallest of their component.

    Null ids, empty and long texts, repeated rows and empty tables as in near_groups; the columns of docs may have any name.
    """
    verdicts = near_groups(docs, id_col, text_col, words, percent, with_hash=True)
    return keep_rows(docs, verdicts, id_col, text_col)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2)


QUERIES = {"op7_near_dedup": op7_near_dedup}
SQL = {
    "op7_near_dedup": r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    b AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS hits FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT p, q FROM b JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * hits >= 80 * (x.n + y.n - hits)),
    l AS MATERIALIZED (SELECT p AS a, q AS b FROM e UNION ALL SELECT q, p FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id, d.doc_id = coalesce(min(r.b), d.doc_id) AS kept
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""
}
