"""Toxicity by maximum-scoring segments.

Tokens are runs of letters, lower-cased. A token's log-odds between toxic and clean documents have a Dirichlet prior in
proportion to its count in all documents, among the tokens that labelled documents have (the log-odds ratio with an informative prior); the same is done for prefixes
of 4, 5 and 6 bytes, to which a token falls back. Log-odds are shrunk by their significance: not at all where chance is out of the question, to zero
where it isn't. A token scores its shrunk log-odds, positive or negative, less ``DRIFT``, so clean text drifts down. One linear scan finds all
maximal segments (the passages).

A segment of score S in n tokens has the extreme-value p-value 1 - exp(-K n e^(-lambda S)), where lambda solves the
moment equation of the scores of clean tokens and K is fitted to clean documents. A document's evidence is the sum of the
log p-values of its significant passages; a logistic curve on it, fitted by Newton steps, is the score.

The labelled side is a sample of at most ``max_labelled`` documents, written once; the prior and the scoring cover every whole text. Texts without letters
have no evidence and so the curve's lowest score; without labels of both kinds every score is about 1e-13. Repeated rows count each time, but of rows with
the id of a label one is used for the curve. Columns of the input named ``score``, ``predicted`` or ``passages`` give way; others pass through. An empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, with_columns
from .labelled import sampled_labels

TOKEN = re.compile(rb"[a-z\x80-\xff]+")
PREFIXES = (6, 5, 4)
PRIOR = 500.0  # pseudo-tokens of the prior
DRIFT, MOST, LEAST_DOCS = 0.3, 6.0, 4
SIGNIFICANT = 0.05
MAX_LABELLED = 40_000
FLUSH = 1_000_000  # tokens that a task counts before it hands them on


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall(text.lower().encode()) if text else []


def features(token: bytes) -> list[bytes]:
    """The token, marked as whole, then its prefixes, longest first."""
    return [b"=" + token, *[token[:k] for k in PREFIXES if len(token) >= k]]


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many toxic, clean and all documents each token occurs. Documents count, so that one that repeats a word says no more than any other."""

    def counted() -> pa.RecordBatch:
        names = list(every)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), *[pa.array([c[t] for t in names], pa.int64()) for c in (labelled[1], labelled[0], every)]],
            ["token", "toxic", "clean", "n"]
        )

    every, labelled = Counter(), {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(tokens(text))
            every.update(found)
            if label is not None:
                labelled[1 if label else 0].update(found)
            if len(every) > FLUSH:
                yield counted()
                every, labelled = Counter(), {0: Counter(), 1: Counter()}
    yield counted()


def of_tokens(counts: DataFrame) -> DataFrame:
    """Counts of tokens (token, toxic, clean, n) to those of features: a prefix has the sum of its tokens."""
    whole = F.concat(F.lit(b"="), "token")
    prefixes = [F.when(F.octet_length("token") >= k, F.substring("token", 1, k)) for k in PREFIXES]
    rows = counts.select(F.explode(F.array_compact(F.array(whole, *prefixes))).alias("feature"), "toxic", "clean", "n")
    return rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "n")])


def log_odds(counts: DataFrame) -> DataFrame:
    """(feature, odds): the shrunk log-odds of the features of labelled documents that aren't 0. counts: feature, toxic, clean, n.

    The whole-token features partition the text, so their sums are the totals. z is the signed root of the likelihood ratio; chance alone
    hardly passes sqrt(2 ln m) for m features, so the log-odds are multiplied by 1 - (that / z)^2, or 0 if that is negative.
    """
    whole = F.substring("feature", 1, 1) == F.lit(b"=")
    total = counts.where(whole).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("n").alias("n")).first()
    t, c = float(total["t"] or 0), float(total["c"] or 0)
    prior = PRIOR * F.col("n") / max(float(total["n"] or 0), 1.0)
    yt, yc = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(yt / (t + PRIOR - yt)) - F.log(yc / (c + PRIOR - yc))
    both, share = F.col("toxic") + F.col("clean"), min(max(t, 0.5) / max(t + c, 1.0), 1 - 1e-9)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (both * p))).otherwise(F.lit(0.0))
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))))
    tested = counts.where(both >= LEAST_DOCS)
    bar = max(3.0, math.sqrt(2 * math.log(max(tested.count(), 2))))
    return tested.withColumn("z", z).where(F.col("z") > bar).select("feature", (odds * (1 - F.pow(bar / F.col("z"), 2))).alias("odds"))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a line of scores, in order.

    Segments that start where a positive score does wait in a list with the total before them, the total after them, and the place of the
    nearest earlier one that starts lower. Following these places instead of the list makes the scan linear: what a step passes over is never passed over again.
    """
    total = np.cumsum(scores)
    first, last, before, after, lower = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        begin, low, high = i, float(total[i] - scores[i]), float(total[i])
        j = len(first) - 1
        while j >= 0 and before[j] >= low:
            j = lower[j]
        while j >= 0 and after[j] < high:
            begin, low, up = first[j], before[j], lower[j]
            del first[j:], last[j:], before[j:], after[j:], lower[j:]
            j = up
        first.append(begin)
        last.append(i)
        before.append(low)
        after.append(high)
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, before, after, strict=True)]


class ToxicModel:
    def __init__(self, scores: dict[bytes, float], lam: float = 1.0, k: float = 0.1, a: float = 0.0, b: float = -30.0):
        self.scores, self.lam, self.k, self.a, self.b = scores, lam, k, a, b

    def token_score(self, token: bytes) -> float:
        for f in features(token):
            if (s := self.scores.get(f)) is not None:
                return s - DRIFT
        return -DRIFT

    def line(self, found: list[bytes]) -> np.ndarray:
        """The score of every token."""
        known = self.cached
        out = np.empty(len(found))
        for i, token in enumerate(found):
            s = known.get(token)
            if s is None:
                if len(known) > 300_000:
                    known.clear()
                s = known[token] = self.token_score(token)
            out[i] = s
        return out

    @property
    def cached(self) -> dict[bytes, float]:
        if "_cached" not in self.__dict__:
            self._cached: dict[bytes, float] = {}
        return self._cached

    def passages(self, found: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first token, last token, score) of a text, in linear time."""
        return maximal_segments(self.line(found))

    def log_p(self, score: float, n: int) -> float:
        """Minus the natural logarithm of a segment's p-value, 0 at least."""
        e = self.k * max(n, 1) * math.exp(-self.lam * score)
        return -math.log(max(-math.expm1(-e), 1e-300))

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        found = tokens(text)
        weighed = [(self.log_p(s, len(found)), (a, b, s)) for a, b, s in self.passages(found)]
        kept = [x for x in weighed if x[0] >= -math.log(SIGNIFICANT)]
        return sum(p for p, _ in kept), [x for _, x in kept], len(found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.a * math.log1p(evidence) + self.b))))


def solve_lambda(shares: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum p e^(lambda s) = 1 over (p, s), the share and score of clean tokens."""
    f = lambda x: sum(p * math.exp(x * s) for p, s in shares) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 0.05)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge, which keeps separable classes finite."""
    w, z = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        g = z.T @ (p - y) + 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def evidence_udf(shared):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<evidence:double,best:double,n_tokens:bigint,passages:array<struct<first:bigint,last:bigint,score:double>>>")
    def weigh(texts: pa.Array) -> pa.Array:
        model = shared.value
        rows = []
        for t in texts.to_pylist():
            e, kept, n = model.evidence(t)
            best = max((s for _, _, s in kept), default=0.0)
            rows.append({"evidence": e, "best": best, "n_tokens": n, "passages": [{"first": a, "last": b, "score": s} for a, b, s in kept]})
        kind = pa.struct(
            [
                ("evidence", pa.float64()), ("best", pa.float64()), ("n_tokens", pa.int64()),
                ("passages", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))
            ]
        )
        return pa.array(rows, kind)

    return weigh


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """``learn``: a condition on the labels' ``doc_id``; no other label is looked at."""
    from pyspark.sql.functions import arrow_udf

    sc = docs.sparkSession.sparkContext
    sample = sampled_labels(labels, "toxic", max_labelled, learn, id_col).withColumnRenamed(id_col, "__id")
    named = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    marked = named.join(F.broadcast(sample), F.col("__doc") == F.col("__id"), "left").select("text", "label")
    by_token = materialize(
        marked.mapInArrow(
            count_tokens, "token binary, toxic long, clean long, n long"
        ).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "n")])
    )
    by_token = by_token.where("toxic + clean > 0")
    found = log_odds(materialize(of_tokens(by_token))).collect()
    model = ToxicModel({bytes(r["feature"]): max(-MOST, min(r["odds"], MOST)) for r in found})
    if not any(s > DRIFT for s in model.scores.values()):
        return model
    rows = named.join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    # Of rows with the same id one stands for the label, so that there are as many as labels.
    labelled = materialize(rows.groupBy("__doc").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("label").alias("label")).select("text", "label"))
    scored = sc.broadcast(model)

    @arrow_udf("double")
    def hundredths(names: pa.Array) -> pa.Array:
        return pa.array(np.round(scored.value.line(names.to_pylist()), 2), pa.float64())

    bars = by_token.where("clean > 0").groupBy(hundredths(F.col("token")).alias("s")).agg(F.sum("clean").alias("n")).collect()
    clean_total = sum(r["n"] for r in bars)
    # One more clean token at the highest score: a score that clean text never showed isn't impossible there.
    shares = [(r["n"] / (clean_total + 1), r["s"]) for r in bars] + [(1 / (clean_total + 1), max(model.scores.values()) - DRIFT)]
    model.lam = solve_lambda(shares)
    weigh = evidence_udf(sc.broadcast(model))
    seen = labelled.select("label", weigh(F.col("text")).alias("w")).select("label", "w.evidence", "w.best", "w.n_tokens").collect()
    clean = [r for r in seen if not r["label"]]
    hit = [r for r in clean if r["best"] > 0]
    if hit:  # K such that as many clean documents exceed their own best score as the formula says
        model.k = max(1e-6, min(1.0, len(hit) / sum(r["n_tokens"] * math.exp(-model.lam * r["best"]) for r in hit) * len(hit) / len(clean)))
    weigh = evidence_udf(sc.broadcast(ToxicModel(model.scores, model.lam, model.k)))
    seen = labelled.select("label", weigh(F.col("text")).alias("w")).select("label", "w.evidence").collect()
    y = np.array([1.0 if r["label"] else 0.0 for r in seen])
    if 0 < y.sum() < len(y):
        model.a, model.b = logistic(np.log1p(np.array([r["evidence"] for r in seen])), y)
    return ToxicModel(model.scores, model.lam, model.k, model.a, model.b)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages`` (token spans with their scores)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(t):
        line = F.lit(model.a) * F.log1p(t["evidence"]) + F.lit(model.b)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), line))))
        return {"score": p, "predicted": F.when(p >= threshold, 1).otherwise(0), "passages": t["passages"]}

    return with_columns(docs, evidence_udf(shared)(F.col(text_col)), judged)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
