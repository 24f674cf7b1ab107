"""URL filter: rules on host and path first, then a logistic regression on hashed character n-grams.

The model is trained from a small labelled table of urls (MAX_LABELLED rows at most are used) and
is a vector of 2**BITS weights, so what is broadcast has a fixed size.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

BITS = 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000
#: A page is blocked from this probability on; half would block what the model knows nothing of.
THRESHOLD = 0.65
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# Words of the labelled table, of urls to block and of others.
BLOCKED_WORDS = (
    "casino poker slots roulette jackpot betting bets sportsbook lottery bingo pills viagra cialis pharma steroids weightloss porn xxx adult sex escort "
    "webcam nude dating loans payday credit forex bitcoin replica rolex warez crack keygen serial torrent malware phishing spam tracker adserver popunder clicks cheap free win bonus winner prize"
).split()
ALLOWED_WORDS = (
    "library museum history science weather garden recipes cooking travel city council school college university research journal archive news press daily "
    "health clinic hospital music theatre cinema film books poetry language grammar maths physics chemistry biology nature forest river mountain football tennis cycling climbing family "
    "children teacher market farm bakery coffee bread village church parish law court justice policy budget energy water rail bus station house roof paint wood design art gallery photo camera code software linux data map atlas blog notes forum wiki"
).split()
PREFIXES = ("", "www.", "blog.", "m.")
ENDINGS = ("com", "org", "net", "info", "example.com", "example.org", "example.net")
LANGUAGES = ("en", "fr", "de", "es")
SYLLABLES = ("ba", "ro", "ti", "len", "mar", "ko", "su", "vin", "del", "pa", "the", "ring", "sho", "ly", "tion", "and")


def labelled_urls(spark: SparkSession, each: int = 1000, seed: int = 11) -> DataFrame:
    """(url, label): the same number of urls to block (1) and to allow (0), made from the words by a rule.

    Of those to block a third have both a host and a path of such words, a third the host alone, a third the path alone; the
    rest of each, and all of the others, are everyday words, made-up names, numbers and languages.
    """
    r = random.Random(seed)
    letters = lambda: "".join(r.choice("abcdefghiklmnoprstuvwhtn") for _ in range(r.randint(3, 8)))
    made_up = lambda: letters() if r.random() < 0.5 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 3)))
    plain = lambda: r.choice(ALLOWED_WORDS) if r.random() < 0.5 else made_up()
    name = lambda word: (word() + r.choice(("-", "")) + word() if r.random() < 0.6 else word()) + r.choice(("", "", str(r.randint(1, 999))))
    bad = lambda: r.choice(BLOCKED_WORDS)
    host = lambda word: f"{r.choice(PREFIXES)}{name(word)}.{r.choice(ENDINGS)}"

    def path(word) -> str:
        some = [r.choice(LANGUAGES)] if r.random() < 0.5 else []
        some += [name(word) for _ in range(r.randint(0 if word is plain else 1, 2))] + ([str(r.randint(1, 9999))] if r.random() < 0.6 else [])
        return "/" + "/".join(some) + r.choice(("", "", "/", ".html"))

    kinds = ((bad, bad), (bad, plain), (plain, bad))
    rows = [(f"https://{host(kinds[k % 3][0])}{path(kinds[k % 3][1])}", 1) for k in range(each)] + [(f"https://{host(plain)}{path(plain)}", 0) for _ in range(each)]
    return spark.createDataFrame(rows, "url string, label int")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a scheme."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    tail = rest[end:]
    return host, tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed columns and values of the n-grams of many urls."""
    rows, cols = [], []
    for salt, parts in ((1, hosts), (2, paths)):
        raw = [f"^{x}$".encode("utf-8", "surrogatepass") for x in parts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        lengths = np.array([len(x) for x in raw], dtype=np.int64)
        owner = np.repeat(np.arange(len(raw)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the part's end
        for n in GRAMS:
            if len(data) < n:
                continue
            h = np.zeros(len(data) - n + 1, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(257) + data[k : len(data) - n + 1 + k]
            ok = left[: len(h)] >= n
            rows.append(owner[: len(h)][ok])
            cols.append((mix(h[ok] * np.uint64(4) + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64))
    r, c = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, cols))
    return r, c, 1 / np.sqrt(np.bincount(r, minlength=len(hosts)).clip(1))[r]


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", epochs: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from at most MAX_LABELLED rows (by a hash of the url), by full-batch gradient steps.

    Rows without a label are left out. Without rows of both classes the model allows everything.
    """
    some = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("u"), "u", "y").limit(MAX_LABELLED).collect()
    w, y = np.zeros(1 << BITS), np.array([r.y for r in some], dtype=float)
    if not len(y) or y.min() == y.max():
        return w, -1.0
    hosts, paths = zip(*(split_url(r.u) for r in some), strict=True)
    r, c, v = features(list(hosts), list(paths))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    b, g2, gb2 = 0.0, np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):
        err = weight * (1 / (1 + np.exp(-(b + np.bincount(r, v * w[c], minlength=len(y))))) - y)
        g, gb = np.bincount(c, v * err[r], minlength=len(w)) + l2 * w / len(w), err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.1 * gb / np.sqrt(gb2)
    return w, b


def probabilities(model: tuple[np.ndarray, float], hosts: list[str], paths: list[str]) -> np.ndarray:
    r, c, v = features(hosts, paths)
    return 1 / (1 + np.exp(-(model[1] + np.bincount(r, v * model[0][c], minlength=len(hosts)))))


def rule_index(rules) -> dict[str, list[tuple[str, str, str]]]:
    by: dict[str, list] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((host + path, path, verdict))
    return by


def match_rule(by: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits: its string and verdict."""
    best = None
    while by:
        for text, start, verdict in by.get(host, ()):
            if path.startswith(start) and (best is None or len(text) > len(best[0])):
                best = (text, verdict)
        if "." not in host:
            return best
        host = host.partition(".")[2]
    return best


def judge_urls(pages: DataFrame, model: tuple[np.ndarray, float], rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    score is the model's probability of a page to block, whatever the rules say. A null url, one
    without a scheme or an empty one has an empty host and path; it is judged by the model alone. Of rules of one
    length the first stays. Repeated rows and null ids are rows like any other, very long urls are judged whole, other columns of any
    name are ignored, and an empty table gives an empty result.
    """
    shared, by = pages.sparkSession.sparkContext.broadcast(model), rule_index(rules)

    def run(batches):
        for b in batches:
            pairs = [split_url(u) for u in b.column("_url").to_pylist()]
            hosts, paths = [p[0] for p in pairs], [p[1] for p in pairs]
            score = probabilities(shared.value, hosts, paths) if pairs else np.zeros(0)
            found = [match_rule(by, *p) for p in pairs]
            verdict = [f[1] if f else ("block" if s >= threshold else "allow") for f, s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)], names=["_id", "host", "path", "rule", "verdict", "score"])

    out = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url")).mapInArrow(run, "_id long, host string, path string, rule string, verdict string, score double")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


QUERIES = {"op1_url_filter": op1_url_filter}
SQL: dict[str, str] = {}
