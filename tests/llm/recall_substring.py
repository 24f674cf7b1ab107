"""python tests/llm/recall_substring.py SF_DIR: of the documents that share a stretch of 52 words with another one, byte for byte, how many op5 finds, and how many of their bytes.

Windows are looked up in a plain dictionary, so this is for small tables.
"""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = 52


def shared_windows(texts: dict[int, bytes], words: int = WORDS) -> dict[int, list[tuple[int, int]]]:
    """For each document the windows of so many words (start and end in bytes) that another document holds as well."""
    import numpy as np

    from echoloom.llm.common import word_spans

    seen: dict[int, set] = defaultdict(set)
    windows = {}
    for i, t in texts.items():
        a, b = word_spans(np.frombuffer(t, np.uint8))
        windows[i] = [(int(s), int(e)) for s, e in zip(a[: len(a) - words + 1], b[words - 1 :], strict=True)] if len(a) >= words else []
        for s, e in windows[i]:
            seen[hash(t[s:e])].add(i)
    return {i: [(s, e) for s, e in w if len(seen[hash(texts[i][s:e])]) > 1] for i, w in windows.items()}


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from echoloom.llm import substring_dedup

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    want = {i: w for i, w in shared_windows(texts).items() if w}
    got = defaultdict(list)
    for r in substring_dedup.repeated_spans(docs).select("_id", "start", "end").collect():
        got[r._id].append((r.start, r.end))
    whole = in_spans = 0
    missed = []
    for i, windows in want.items():
        need, have = bytearray(len(texts[i])), bytearray(len(texts[i]))
        for s, e in windows:
            need[s:e] = b"\1" * (e - s)
        for s, e in got[i]:
            have[s:e] = b"\1" * (e - s)
        whole += sum(need)
        in_spans += sum(x & y for x, y in zip(need, have, strict=True))
        if i not in got or not got[i]:
            missed.append(i)
    print(f"documents {len(want)}, found {len(want) - len(missed)}, missed {missed[:20]}; bytes {whole}, in spans {in_spans / max(1, whole):.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
