"""Suffix-array dedup of passages, with a sparse suffix array.

Words are runs without ASCII white space. Of all suffixes only those are retained that begin at a minimiser: the position
of the smallest hash of ``k`` words among ``min_words - k + 1`` neighbouring ones. Content alone selects them, so two
copies of a passage of ``min_words`` words retain at least one suffix at the same place inside it.

1. A pass over the texts lists each document's minimisers. Equal texts are one text here: their documents repeat each
   other as a whole, and only the one with the smallest id goes on.
2. Minimisers that occur once can't lie in a repeat. The suffixes of the others are fetched with their contexts,
   ``min_words - k`` words to the left and ``min_words`` to the right.
3. Suffixes are sorted and neighbours compared; neighbours' common prefixes cut the order into intervals, and a match to the
   right is extended to the left by comparing left contexts inside each interval. A match counts from ``min_words``
   words and two documents on. Longer passages are chains of such matches, one per minimiser.
4. Overlapping matches of a document become one span.

A minimiser that more than ``hot`` suffixes share would make a large group: its suffixes are turned into the hashes of
all ``min_words``-word windows around them, which are counted with map-side combination, so that they never meet in a task. What a
common window, text or minimiser has in common goes back to its rows by a join in which the commonest, whose number is bounded, are broadcast.

Words compare by 32-bit hashes, at least ``min_words`` of them in a row. Null texts and null ids take no part; repeats
inside one document, or between rows with the same id, are none, while each text of such an id has the spans of its own that others repeat; short or empty texts have none; ties don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize

MIN_WORDS, K = 50, 12
HOT = 20_000
BIN_ROWS = 40_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH = "doc_id long, t1 long, first_word long, end_word long, other_doc_id long"


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, text.encode().split()), np.uint32)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * BASE
        out ^= out >> np.uint64(31)
    return out


def minimisers(h: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the retained suffixes."""
    runs, window = rolling(h, k), min_words - k + 1
    if len(runs) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    picked = []
    for at in range(0, len(runs) - window + 1, 1 << 16):
        part = runs[at : at + (1 << 16) + window - 1]
        picked.append(at + np.arange(len(part) - window + 1) + np.lib.stride_tricks.sliding_window_view(part, window).argmin(1))
    pos = np.unique(np.concatenate(picked))
    return pos, runs[pos]


def list_minimisers(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h = word_hashes(text)
                rows.append((len(h), *minimisers(h, min_words, k)))
            lists = lambda j, kind: pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(r[j]) for r in rows])]).astype(np.int32),
                pa.array(np.concatenate([r[j] for r in rows] or [np.zeros(0)]).astype(kind))
            )
            names = ["doc_id", "t1", "t2", "n_words", "pos", "key"]
            keys = pa.ListArray.from_arrays(lists(1, np.int32).offsets, pa.array(np.concatenate([r[2] for r in rows] or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array([r[0] for r in rows], pa.int64()),
                    lists(1, np.int32), keys
                ],
                names
            )

    return run


def fetch_contexts(min_words: int, k: int):
    """Rows (doc_id, t1, text, suffixes: list of (pos, key, n)) to one row per suffix with the hashes of the words around it."""
    left = min_words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t1, text, suffixes in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "t1", "text", "suffixes")], strict=True):
                h = word_hashes(text)
                padded = np.concatenate([np.zeros(left, np.uint32), h, np.zeros(min_words, np.uint32)])
                for at in range(0, len(suffixes), 4096):
                    part = suffixes[at : at + 4096]
                    pos = np.array([s["pos"] for s in part], np.int64)
                    around = padded[pos[:, None] + np.arange(left + min_words)]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * m, pa.int64()), pa.array([t1] * m, pa.int64()), pa.array(pos),
                            pa.array([len(h)] * m, pa.int64()), pa.array([s["key"] for s in part], pa.int64()),
                            pa.array([s["n"] for s in part], pa.int64()), pa.array([r.tobytes() for r in around.astype(">u4")], pa.binary())
                        ],
                        ["doc_id", "t1", "pos", "n_words", "key", "n", "around"]
                    )

    return run


def compare_neighbours(min_words: int, k: int):
    """Grouped map: a bin of suffixes to the matches of each."""
    left = min_words - k

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "t1", "first_word", "end_word", "other_doc_id")})
        around = np.frombuffer(b"".join(pdf["around"]), ">u4").reshape(len(pdf), left + min_words)
        order = np.argsort(np.ascontiguousarray(around[:, left:]).view(f"V{4 * min_words}").ravel(), kind="stable")
        around = around[order].astype(np.uint32)
        doc, t1, pos, total = (pdf[c].to_numpy(np.int64)[order] for c in ("doc_id", "t1", "pos", "n_words"))
        right = around[:, left:]
        common = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(1)
        # Hash of the 0, 1, 2, ... words before each suffix.
        before, past = np.zeros((len(doc), left + 1), np.uint64), np.zeros(len(doc), np.uint64)
        for a in range(1, left + 1):
            past = (past ^ around[:, left - a]) * BASE
            past ^= past >> np.uint64(29)
            before[:, a] = past
        first, last, other = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.int64), np.full(len(doc), np.iinfo(np.int64).max)
        for a in range(left + 1):
            interval = np.concatenate([[0], np.cumsum(common < min_words - a)])
            fits = np.flatnonzero((pos >= a) & (pos - a + min_words <= total))
            if len(fits) < 2:
                continue
            by = np.lexsort((before[fits, a], interval[fits]))
            at = fits[by]
            new = np.concatenate([[True], (interval[at][1:] != interval[at][:-1]) | (before[at, a][1:] != before[at, a][:-1])])
            group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            low, high = np.minimum.reduceat(doc[at], starts)[group], np.maximum.reduceat(doc[at], starts)[group]
            hit = low != high
            at, low, high = at[hit], low[hit], high[hit]
            first[at] = pos[at] - a
            last[at] = np.where(last[at] == 0, pos[at] - a + min_words, last[at])
            other[at] = np.minimum(other[at], np.where(low == doc[at], high, low))
        some = np.flatnonzero(first >= 0)
        return pd.DataFrame({"doc_id": doc[some], "t1": t1[some], "first_word": first[some], "end_word": last[some], "other_doc_id": other[some]}) if len(some) else empty

    return run


def window_hashes(min_words: int, k: int):
    """For suffixes of hot minimisers: one row for every window of ``min_words`` words that holds the minimiser."""
    left = min_words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), ">u4").reshape(len(batch), -1).astype(np.uint32)
            doc, t1, pos, total = (batch.column(c).to_numpy() for c in ("doc_id", "t1", "pos", "n_words"))
            for a in range(left + 1):
                fits = (pos >= a) & (pos - a + min_words <= total)
                part = around[fits, left - a : left - a + min_words]
                h1, h2 = np.zeros(len(part), np.uint64), np.full(len(part), 7, np.uint64)
                for i in range(min_words):
                    h1 = (h1 ^ part[:, i]) * BASE
                    h1 ^= h1 >> np.uint64(31)
                    h2 = (h2 + part[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    h2 ^= h2 >> np.uint64(33)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[fits]), pa.array(t1[fits]), pa.array(pos[fits] - a), pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64))
                    ],
                    ["doc_id", "t1", "first_word", "h1", "h2"]
                )

    return run


def matches(docs: DataFrame, min_words: int, k: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, first_word, end_word, other_doc_id) of every match; ``t1``, a hash of the text, tells rows with the same id apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    listed = materialize(
        hashed.mapInArrow(
            list_minimisers(min_words, k), "doc_id long, t1 long, t2 long, n_words long, pos array<int>, key array<long>"
        ).where(F.col("n_words") >= min_words)
    )
    other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other_doc_id")
    equal = materialize(listed.groupBy("t1", "t2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")))
    total = equal.agg(F.sum("n")).first()[0] or 0
    several = equal.where("low <> high")
    whole = join_counted(listed.select("doc_id", "t1", "t2", "n_words"), several, ["t1", "t2"], total).select(
        "doc_id", "t1", F.lit(0).cast("long").alias("first_word"), F.col("n_words").alias("end_word"), other
    )
    least = equal.select(F.col("low").alias("doc_id"), "t1", "t2")
    alone = materialize(
        listed.join(least, ["doc_id", "t1", "t2"]).select(
            "doc_id", "t1", F.explode(F.arrays_zip("pos", "key")).alias("s")
        ).select("doc_id", "t1", "s.pos", "s.key")
    )
    counted = materialize(alone.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared_keys = join_counted(alone, counted.withColumn("times", F.col("n")), ["key"], alone.count())
    kept = materialize(shared_keys.groupBy("doc_id", "t1").agg(F.collect_set(F.struct("pos", "key", F.col("times").alias("n"))).alias("suffixes")))
    n = kept.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    contexts = materialize(
        hashed.select("doc_id", "t1", "text").join(kept, ["doc_id", "t1"]).select("doc_id", "t1", "text", "suffixes").mapInArrow(
            fetch_contexts(min_words, k), "doc_id long, t1 long, pos long, n_words long, key long, n long, around binary"
        )
    )
    bins = max(1, math.ceil(n / BIN_ROWS))
    near = contexts.where(F.col("n") <= hot).withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInPandas(compare_neighbours(min_words, k), MATCH)
    windows = contexts.where(F.col("n") > hot).select("doc_id", "t1", "pos", "n_words", "around").mapInArrow(
        window_hashes(min_words, k), "doc_id long, t1 long, first_word long, h1 long, h2 long"
    )
    per_window = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = materialize(per_window.where("low <> high"))
    # The shared windows' own number of rows is the total here: others don't meet them.
    far = join_counted(windows, shared, ["h1", "h2"], shared.agg(F.sum("n")).first()[0] or 0)
    far = far.select("doc_id", "t1", "first_word", (F.col("first_word") + min_words).alias("end_word"), other)
    return whole.unionByName(near).unionByName(far)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, other_doc_id): spans of at least ``min_words`` words all of whose windows of that length occur in another document too, which may differ from window to window; one such document is named."""
    found = matches(docs, min_words, k, hot, id_col, text_col)
    found = found.groupBy("doc_id", "t1", "first_word").agg(F.max("end_word").alias("end_word"), F.min("other_doc_id").alias("other_doc_id"))
    order = Window.partitionBy("doc_id", "t1").orderBy("first_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("first_word")).cast("int"))
    spans = opened.withColumn("span", F.sum("new").over(order))
    merged = spans.groupBy("doc_id", "t1", "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min("other_doc_id").alias("other_doc_id"))
    return merged.select("doc_id", "first_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "other_doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeated_passages(table(spark, sf_dir, "documents"))
