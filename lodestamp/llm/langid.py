"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and everything but letters becomes a space; its subwords are the runs of 2 to 4 code points that
have no space inside (at the ends a space marks a word's border). Subwords hash into ``BUCKETS`` embeddings, whose mean
goes through a linear layer and a softmax. The model is trained by stochastic gradient descent in numpy on at most
``per_lang`` documents of each language, chosen by hash of id and text, equal rows once, classes weighing alike. On a tenth of them a temperature
calibrates the probabilities and a rejection threshold is set at which accepted predictions reach ``precision``.

Since both layers are linear, one row of logits per bucket is broadcast. Texts that are null or have no letter are ``und``
with score 0 and not accepted; texts of a single letter have one subword. Without training documents all is ``und``. Repeated rows count each
time. Columns of the input named ``lang_pred``, ``score`` or ``accepted`` give way; others pass through. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, with_columns

BUCKETS, DIM, SIZES = 1 << 13, 16, (2, 3, 4)
PER_LANG = 700
EPOCHS, BATCH, RATE = 12, 32, 0.6
PIECE = 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Flag per code point; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(text: str | None) -> np.ndarray | None:
    """Subwords by bucket over the whole text, in pieces of bounded size; None if there is no letter."""
    if not text:
        return None
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(code), PIECE):
        c, w = code[at : at + PIECE + max(SIZES) - 1].astype(np.uint64), letter[at : at + PIECE + max(SIZES) - 1]
        for size in SIZES:
            n = min(len(c) - size + 1, PIECE)
            if n <= 0:
                continue
            h = np.full(n, size, np.uint64)
            for k in range(size):
                h = (h ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # Inside no space, and at least one letter.
            ok = w[:n] | w[size - 1 : size - 1 + n] if size == 2 else np.ones(n, bool)
            for k in range(1, size - 1):
                ok &= w[k : k + n]
            total += np.bincount((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return total


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n = counts(text)
            if n is not None:
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]), pa.array([part], pa.int64()), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                        pa.array([(n[at] / n.sum()).astype("<f4").tobytes()], pa.binary())
                    ],
                    ["lang", "part", "at", "share"]
                )


class LangModel:
    """``logits``: one row per bucket; ``temperature`` and ``floor`` from calibration."""

    def __init__(self, langs: list[str], logits: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.langs, self.logits, self.temperature, self.floor = langs, logits, temperature, floor

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text)
        if n is None or not self.langs:
            return "und", 0.0
        total = n.sum()
        p = softmax((n @ self.logits / max(total, 1))[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list, seed: int = 7, precision: float = 0.99) -> LangModel:
    """rows: lang, part (a hash), at and share as count_batches() gives them."""
    rows = sorted(rows, key=lambda r: (r["part"], r["lang"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return LangModel([], np.zeros((BUCKETS, 0)))
    y = np.array([langs.index(r["lang"]) for r in rows])
    parsed = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in rows]

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for k, i in enumerate(ids):
            x[k, parsed[i][0]] = parsed[i][1]
        return x

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 10], order[len(rows) // 10 :]
    weight = len(used) / (len(langs) * np.maximum(np.bincount(y[used], minlength=len(langs)), 1))
    emb = rng.normal(0, 1.0, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(used), BATCH):
            ids = used[at : at + BATCH] if epoch == 0 else rng.choice(used, min(BATCH, len(used)), replace=False)
            x = dense(ids)
            h = x @ emb
            g = softmax(h @ out)
            g[np.arange(len(ids)), y[ids]] -= 1
            g *= (weight[y[ids]] / len(ids))[:, None]
            # Shares are small numbers: the embeddings' rate is scaled up to match.
            emb -= (rate * 20) * (x.T @ (g @ out.T).astype(np.float32))
            out -= rate * (h.T @ g).astype(np.float32)
    logits = (emb @ out).astype(np.float64)
    held = held if len(held) else used
    z = dense(held) @ logits
    fit = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=fit))
    p = softmax(z / temperature)
    best, right = p.max(1), p.argmax(1) == y[held]
    by = np.argsort(-best, kind="stable")
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
    floor = float(best[by][np.flatnonzero(good).max()]) if good.any() else 1.0
    return LangModel(langs, logits, temperature, floor)


def fit(docs: DataFrame, learn: Column | None = None, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Only rows with a language for which ``learn`` holds are looked at. One count per language (the model has a column for each) and the sample, ``per_lang`` rows a language at most, come to the driver.

    Rows are drawn by a hash of id and text, equal ones once: first by a share that leaves a few more than are due, then by rank among these.
    """
    hashed = F.xxhash64(F.lit("language sample"), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)).alias("part")
    known = docs.where(F.col(lang_col).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed)
    sizes = known.select("lang", "part").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    limits = sizes.select(F.col("lang").alias("l"), F.ceil(F.lit((per_lang + 10 * per_lang**0.5) * 1_000_000.0) / F.col("n")).alias("grains"))
    grain = F.pmod(F.xxhash64("part"), F.lit(1_000_000))
    drawn = known.join(F.broadcast(limits), F.col("lang") == F.col("l")).where(grain < F.col("grains")).dropDuplicates(["lang", "part"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("part"))
    sample = drawn.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "text", "part")
    return train(sample.mapInArrow(count_batches, "lang string, part long, at binary, share binary").collect())


def predict(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    accepted = lambda g: (g["lang"] != "und") & (g["score"] >= model.floor)
    return with_columns(docs, guess(F.col(text_col)), lambda g: {"lang_pred": g["lang"], "score": g["score"], "accepted": accepted(g)})


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
