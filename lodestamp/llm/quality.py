"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are runs of word bytes or of other visible bytes; their unigrams and bigrams hash into ``BUCKETS`` buckets. Counts
over all documents give the raw multinomial, counts over the labelled documents of quality 1 the trusted one, both with
add-``SMOOTH`` smoothing. A document's verdict is its mean log ratio over its n-grams (length-normalised) against one
threshold for all documents, so equal texts get equal verdicts. The threshold is the histogram edge that rejects the
most labelled documents of quality 0 for the fewest of quality 1, the latter weighing ``CLEAN_WEIGHT`` times as much.

Counts, model and threshold come from all documents and all labels; the labelled texts are written once. An id with several labels has the smallest.
Null and empty texts have no words and fail the base rules. Without labels of both kinds the likelihood ratio rejects nobody. Repeated rows count
each time they occur. Columns of the input named like a new one give way; others pass through. An empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, with_columns
from .labelled import all_labels

BUCKETS = 1 << 16
SMOOTH = 1.0
CLEAN_WEIGHT = 20
GRID = 200  # histogram bars per unit of the log ratio
TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x00-\x20]+")
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
BASE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,llr:double>"


def buckets(text: bytes) -> np.ndarray:
    """Bucket of every unigram and bigram."""
    h = np.fromiter(map(zlib.crc32, TOKEN.findall(text)), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.concatenate([h, pairs]).astype(np.int64) & (BUCKETS - 1)


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    keys, last = ids[: n - window + 1], n - window + 1
    for k in range(1, window):
        keys = keys * len(names) + ids[k : k + last]
        if len(names) > 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(last, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : k + last] |= again
    return int(covered.sum())


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def each(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, one at a time as Python objects."""
    return (t.as_py() for t in texts)


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: n-grams by bucket in all its texts."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in each(batch.column(0)):
            if text:
                n += np.bincount(buckets(text.encode()), minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])


def log_ratios(raw_counts: list, trusted_counts: list) -> np.ndarray:
    raw, trusted = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for total, counts in ((raw, raw_counts), (trusted, trusted_counts)):
        for row in counts:
            total[row["bucket"]] += row["n"]
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def mean_ratio(text: str, weights: np.ndarray) -> float:
    at = buckets(text.encode())
    return float(weights[at].mean()) if len(at) else 0.0


def pick_threshold(bars: list) -> float:
    """bars: rows (bar, label, n). The lower edge of the bar from which documents are kept; minus infinity if one kind of label is missing."""
    totals = {k: sum(r["n"] for r in bars if r["label"] == k) for k in (0, 1)}
    if not totals[0] or not totals[1]:
        return float("-inf")
    best, at, clean, junk = totals[0] / totals[0], None, 0, 0
    for edge in sorted({r["bar"] for r in bars}):
        here = {r["label"]: r["n"] for r in bars if r["bar"] == edge}
        clean, junk = clean + here.get(1, 0), junk + here.get(0, 0)
        cost = CLEAN_WEIGHT * clean / totals[1] + 1 - junk / totals[0]
        if cost < best:
            best, at = cost, edge + 1
    return float("-inf") if at is None else at / GRID


class QualityModel:
    """Weights (one double per bucket) and the threshold."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of the labelled documents that have a text. Every label is broadcast, so that texts aren't shuffled: an id and a number each, which grow with the labels."""
    known = all_labels(labels, "quality").withColumnRenamed("doc_id", "__id")
    said = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).where("text <> ''")
    return said.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    from pyspark.sql.functions import arrow_udf

    labelled = materialize(with_labels(docs, labels, id_col, text_col))
    counted = lambda texts: texts.mapInArrow(count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    weights = log_ratios(counted(docs.select(F.col(text_col).alias("text"))), counted(labelled.where("label = 1").select("text")))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @arrow_udf("int")
    def bar(texts: pa.Array) -> pa.Array:
        return pa.array([int(np.floor(mean_ratio(t, shared.value) * GRID)) if t else None for t in each(texts)], pa.int32())

    bars = labelled.select("label", bar(F.col("text")).alias("bar")).groupBy("bar", "label").agg(F.count("*").alias("n"))
    return QualityModel(weights, pick_threshold(bars.collect()))


def rate(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept."""
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    @arrow_udf(BASE)
    def measure(texts: pa.Array) -> pa.Array:
        rows = [(*base_metrics(t or ""), mean_ratio(t or "", shared.value)) for t in each(texts)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64() if k == 5 else pa.int64()) for k in range(6)], MEASURES)

    def verdict(q):
        failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
        return {**{c: q[c] for c in MEASURES}, "base_failed": failed, "kept": ~failed & (q["llr"] >= F.lit(model.threshold))}

    return with_columns(docs, measure(F.col(text_col)), verdict)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rate(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
