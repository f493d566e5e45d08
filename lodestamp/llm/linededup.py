"""Line dedup: frequent lines leave every document, found through a sharded minimal perfect hash.

Steps, all of them Spark jobs:

1. Every document's distinct line keys become 128-bit hashes; a map-side combined ``groupBy`` counts documents per hash.
2. The distinct hashes of lines that repeat are cut into shards by hash. A grouped map builds for each shard a
   minimal perfect hash (levels of collision-free bits) that indexes two arrays: 64-bit fingerprints and counts.
   A line outside the index meets a foreign fingerprint, so lines of a single document, which no threshold drops, have no slot and no row.
3. Documents probe the arrays, and the count that they find there decides. Shards of the most frequent lines, at most ``resident_keys`` keys (about
   20 bytes each), are broadcast. If more lines than that are in ``min_docs`` documents, those left over are routed by shard to the remaining shards
   as bare hashes and only the positions of dropped lines come back. The lines of a shard, rare ones included, are dealt by
   row and position into parts of about ``ROUTED_LINES``, and the shard's arrays go to each of its parts: neither a hot line nor
   many lines for few shards make a group larger.

Null or empty texts are one empty line. Keys shorter than ``min_chars`` code points are never dropped. Rows count as documents,
also where they repeat a ``doc_id``. Extra columns pass through untouched, but for those named ``kept_text``, ``n_lines`` or ``n_dropped``, which give way.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize

GAMMA = 1.5
SHARD_KEYS = 1 << 16
ROUTED_LINES = 1 << 19
SHARD_SCHEMA = "shard long, salt long, level_sizes binary, bits binary, fingerprints binary, counts binary"


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer; each salt gives an independent hash."""
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key sits in the first level where nobody else took its bit; its rank among set bits is its slot."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            m = max(8, int(len(keys) * GAMMA))
            at = (mix64(keys, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some keys that were not built in (others land on a foreign slot)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self.starts[level] + (mix64(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def salted(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key from both hashes of a line."""
    return mix64(h1, 1000 + salt) ^ h2


class Shard:
    def __init__(self, row):
        self.salt = int(row.salt)
        self.hash = PerfectHash(np.frombuffer(row.level_sizes, np.int64), np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool))
        self.fingerprints = np.frombuffer(row.fingerprints, np.uint64)
        self.counts = np.frombuffer(row.counts, np.int64)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each line by the count array; 0 where the fingerprint says that the line is not in the index."""
        if not len(self.counts):
            return np.zeros(len(h1), np.int64)
        slot = self.hash.slots(salted(h1, h2, self.salt))
        known = (slot >= 0) & (self.fingerprints[slot] == h2)
        return np.where(known, self.counts[slot], 0)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64)
    n = pdf["n_docs"].to_numpy(np.int64)
    salt = 0
    while len(np.unique(keys := salted(h1, h2, salt))) < len(keys):  # two lines must not share a slot: other keys for this shard
        salt += 1
    hashed = PerfectHash.build(keys)
    slot = hashed.slots(keys)
    fingerprints, counts = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
    fingerprints[slot], counts[slot] = h2, n
    bits = np.packbits(hashed.bits)
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])], "salt": [salt], "level_sizes": [hashed.sizes.tobytes()], "bits": [bits.tobytes()],
            "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()]
        }
    )


def line_keys(text: Column):
    """The lines of a text, and the function from a line to its key."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return lines, lambda x: F.btrim(ascii_lower(x), F.lit(SPACES))


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) of every distinct line key."""
    lines, key = line_keys(F.col(text_col))
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines, key))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))


def build_index(counts: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    n_shards = max(1, math.ceil(n_keys / SHARD_KEYS))
    keyed = counts.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long"))
    return keyed.groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA), n_shards


def resident_floor(counts: DataFrame, resident_keys: int) -> tuple[int | None, int]:
    """The smallest power-of-two document count from which at most ``resident_keys`` lines remain, and how many do. One row per power comes back."""
    powers = counts.groupBy(F.floor(F.log2(F.col("n_docs"))).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()
    floor, kept = None, 0
    for row in sorted(powers, key=lambda r: -r["p"]):
        if kept + row["n"] > resident_keys:
            break
        floor, kept = 2 ** row["p"], kept + row["n"]
    return floor, kept


def probe_resident(shards, n_shards: int, min_docs: int):
    """Arrow UDF: line hashes of each document to a flag per line, true where the line is frequent."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<boolean>")
    def probe(first: pa.Array, second: pa.Array) -> pa.Array:
        index = resident(shards)
        offsets = first.offsets
        h1 = first.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        h2 = second.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        found = np.zeros(len(h1), bool)
        shard = np.mod(h1, n_shards)
        for k in np.unique(shard):
            if int(k) in index:
                at = np.flatnonzero(shard == k)
                found[at] = index[int(k)].count(h1[at].view(np.uint64), h2[at].view(np.uint64)) >= min_docs
        base = offsets[0].as_py() if len(offsets) else 0
        return pa.ListArray.from_arrays(pa.array(offsets.to_numpy() - base, pa.int32()), pa.array(found))

    return probe


_RESIDENT: dict = {}


def resident(broadcasted) -> dict[int, Shard]:
    """The broadcast shards, unpacked once per worker."""
    if _RESIDENT.get("id") != broadcasted.value[0]:
        _RESIDENT.update(id=broadcasted.value[0], shards={r.shard: Shard(r) for r in broadcasted.value[1].itertuples()})
    return _RESIDENT["shards"]


def probe_routed(key, lines: pd.DataFrame, shard: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    if not len(lines) or not len(shard):
        return pd.DataFrame({"row": pd.Series(dtype="int64"), "pos": pd.Series(dtype="int32")})
    hit = Shard(next(shard.itertuples())).count(lines["h1"].to_numpy(np.int64).view(np.uint64), lines["h2"].to_numpy(np.int64).view(np.uint64)) >= min_docs
    return lines.loc[hit, ["row", "pos"]]


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, resident_keys: int = 500_000) -> DataFrame:
    """``docs`` with the columns ``kept_text``, ``n_lines`` and ``n_dropped``: lines whose key is in at least ``min_docs`` rows are gone.

    A table without rows gives one without rows; a document whose lines all go keeps an empty text.
    """
    spark = docs.sparkSession
    counts = materialize(line_counts(docs, text_col, min_chars).where(F.col("n_docs") >= min(2, min_docs)))
    floor, n_resident = resident_floor(counts, resident_keys)
    left = counts.where(F.col("n_docs") >= min_docs)
    left = left if floor is None else left.where(F.col("n_docs") < floor)
    n_left = left.count()
    lines, key = line_keys(F.col(text_col))
    keep = lambda x, hit: F.when(hit, F.lit(None)).otherwise(x)
    work = docs.select("*", F.struct(lines.alias("lines")).alias("__ld"))
    if n_resident:
        index, n_shards = build_index(counts.where(F.col("n_docs") >= floor), n_resident)
        shards = spark.sparkContext.broadcast((uuid.uuid4().hex, index.toPandas()))
        probe = probe_resident(shards, n_shards, min_docs)
        keys = lambda: F.transform(lines, key)
        flags = probe(
            F.transform(keys(), lambda k: F.when(F.char_length(k) >= min_chars, F.xxhash64(k)).otherwise(F.lit(0))),
            F.transform(keys(), lambda k: F.when(F.char_length(k) >= min_chars, F.xxhash64(F.lit("second"), k)).otherwise(F.lit(0)))
        )
    else:
        flags = F.transform(lines, lambda x: F.lit(False))
    work = work.select("*", flags.alias("__ld_hit"))
    if n_left:
        work = route(work, left, n_left, key, min_chars, min_docs)
    kept = F.filter(F.zip_with("__ld.lines", "__ld_hit", keep), lambda x: x.isNotNull())
    if n_left:  # positions that neither side of the index drops, as a set: long documents cost no more a line
        stay = F.filter(F.transform("__ld_hit", lambda hit, i: F.when(~hit, i.cast("int"))), lambda i: i.isNotNull())
        gone = F.coalesce("__ld_gone", F.array().cast("array<int>"))
        kept = F.transform(F.array_except(stay, gone), lambda i: F.get("__ld.lines", i))
    n_lines = F.size("__ld.lines").cast("long")
    made = {"kept_text": F.array_join("__ld_kept", "\n"), "n_lines": n_lines, "n_dropped": (n_lines - F.size("__ld_kept")).cast("long")}
    out = work.select("*", kept.alias("__ld_kept")).drop(*made).select("*", *[c.alias(name) for name, c in made.items()])
    return out.drop(*[c for c in out.columns if c.startswith("__ld")])


def route(work: DataFrame, counts: DataFrame, n_keys: int, key, min_chars: int, min_docs: int) -> DataFrame:
    """The rest of the index: hashes of lines that no resident shard knows go to their shard, positions of frequent ones come back by row, in ``__ld_gone``."""
    index, n_shards = build_index(counts, n_keys)
    work = materialize(work.withColumn("__ld_row", F.monotonically_increasing_id()))
    exploded = work.select(
        F.col("__ld_row").alias("row"),
        F.posexplode(
            F.zip_with("__ld.lines", "__ld_hit", lambda x, hit: F.struct(key(x).alias("key"), hit.alias("hit")))
        ).alias("pos", "line")
    )
    lines = exploded.where(~F.col("line.hit") & (F.char_length("line.key") >= min_chars)).select(
        "row", "pos", F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit("second"), "line.key").alias("h2")
    )
    lines = lines.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long"))
    parts = materialize(lines.groupBy("shard").agg(F.ceil(F.count("*") / ROUTED_LINES).cast("int").alias("parts")))
    lines = lines.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("row", "pos"), F.col("parts")).cast("int")).drop("parts")
    index = index.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    gone = lines.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInPandas(lambda name, a, b: probe_routed(name, a, b, min_docs), "row long, pos int")
    gone = gone.groupBy(F.col("row").alias("__ld_row")).agg(F.collect_set("pos").alias("__ld_gone"))
    return work.join(gone, "__ld_row", "left")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT rowid AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
), line AS (
  SELECT r, doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM line
), gone AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, g.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN gone g USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
