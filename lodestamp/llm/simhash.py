"""SimHash near-dedup with BK-trees.

Fingerprint: 64 bits, each 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles, repeats
included. Texts with fewer words than a shingle have one shingle, their whole sequence; texts without words (null and
empty ones too) have fingerprint zero and link like any other.

Equal fingerprints are one class. Classes link at ``radius`` or fewer differing bits. Two such fingerprints agree on at least one of
``radius + 1`` blocks of bits, so each distinct fingerprint goes to one shard per block, named by the block's value. In a
shard a BK-tree (children keyed by their Hamming distance to the parent) answers a query by following only the edges
within the radius of the distance to the node. All trees of a task are built and searched together, level by level.

A shard with more than ``shard_size`` fingerprints is hot. Two of its fingerprints that link differ in ``radius`` bits at most of
those that the shard doesn't fix, so they agree on one of ``radius + 1`` blocks of these as well: a hot shard is dealt anew by such blocks, and
again while a part is hot. This loses no link, costs ``radius + 1`` rows a fingerprint and level, and ends, for every level fixes
more bits and fingerprints are distinct. Trees hold distinct fingerprints only, so exact copies cost nothing, and a task keeps no pairs: it merges
what it finds into a forest and returns at most one edge per fingerprint. Star contraction joins the forests.

Trees of cold shards travel to the tasks that search them, as many shards to a task as fill it; they aren't broadcast, for all of them together grow
with the corpus. Each fingerprint finds its class by a join in which the classes of very many documents, whose number is bounded, are broadcast.

Rows count as documents also where they repeat a ``doc_id``. Null ids take part, but a component's id is its smallest id
that isn't null. A column ``fp`` of the input gives way to the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, with_columns
from .graph import components

SHARD_SIZE = 16_384
STEP = 1 << 20


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle. ASCII letters are lower-cased and words end at ASCII white space, as bytes do it by themselves."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(found) - words + 1
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set, counted in blocks."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = np.array([majority(shingle_hashes(t or "", words)) for t in texts.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return with_columns(docs, fingerprint(F.col(text_col)), lambda fp: {"fp": fp})


class Forest:
    """BK-trees of many groups at once. Groups are numbered from 0; items of a group lie in one tree."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.fps, n = fps, len(fps)
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        # Items wait under a tree name; the first of each name becomes the node, the others move on to a child by distance.
        items, names, above = np.arange(n), groups.astype(np.int64), np.full(n, -1, np.int64)
        labels = np.zeros(n, np.int64)
        self.roots = None
        while len(items):
            order = np.argsort(names, kind="stable")
            items, names, above, labels = items[order], names[order], above[order], labels[order]
            first = np.concatenate([[True], names[1:] != names[:-1]])
            nodes = items[first]
            self.parent[nodes], self.edge[nodes] = above[first], labels[first]
            if self.roots is None:
                self.roots = np.zeros(int(groups.max()) + 1, np.int64)
                self.roots[names[first]] = nodes
            node = nodes[np.cumsum(first) - 1][~first]
            items = items[~first]
            labels = np.bitwise_count(fps[items] ^ fps[node]).astype(np.int64)
            above, names = node, node * 65 + labels
        keys = self.parent * 65 + self.edge
        self.children = np.argsort(keys, kind="stable")
        self.keys = keys[self.children]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, item) pairs at ``radius`` or less, in portions of bounded size."""
        work = [(np.arange(at, min(at + STEP, len(queries))), roots[at : at + STEP]) for at in range(0, len(queries), STEP)]
        while work:
            q, node = work.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            ends = np.cumsum(n)
            for part in np.split(np.arange(len(q)), np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP))):
                if m := int(n[part].sum()):
                    at = np.repeat(low[part], n[part]) + np.arange(m) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                    work.append((np.repeat(q[part], n[part]), self.children[at]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after the links a-b: hooking to the smaller label and pointer jumping."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def search_shards(radius: int):
    """Grouped map over bins of whole shards (``key``): every fingerprint searches its shard's tree. Returns forest edges."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        _, groups = np.unique(pdf["key"].to_numpy(), return_inverse=True)
        forest = Forest(fps, groups)
        label = np.arange(len(fps))
        for a, item in forest.within(fps, forest.roots[groups], radius):
            if (other := a != item).any():
                label = merged(label, a[other], item[other])
        moved = np.flatnonzero(label != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[moved], "b": signed[label[moved]]})

    return search


def deeper(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of the bits outside it added; none if there are no more bits than ``radius``."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= radius:
        return []
    ends = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


def sharded(classes: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """(fp, key): every fingerprint once in each shard that it belongs to. ``mask`` has the bits that a shard fixes; masks of hot shards come to the driver. Keys of hot shards are broadcast while
    they are ``BROADCAST_KEYS`` at most; beyond, they are joined by shuffle."""
    spark = classes.sparkSession

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        """Rows (fp, mask) by the masks one level deeper."""
        signed = lambda m: int(np.uint64(m).astype(np.int64))
        down = spark.createDataFrame([(signed(m), signed(x)) for m in masks for x in deeper(m, radius)], "mask long, next long")
        return rows.join(F.broadcast(down), "mask").select("fp", F.col("next").alias("mask"))

    keyed = lambda rows: rows.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
    rows, done = keyed(dealt(classes.select("fp", F.lit(0).cast("long").alias("mask")), [0])), None
    while True:
        hot = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_size).select("mask", "key"))
        masks = [m for m in (r["mask"] % 2**64 for r in hot.select("mask").distinct().collect()) if deeper(m, radius)]
        if not masks:
            return rows.select("fp", "key") if done is None else done.unionByName(rows.select("fp", "key"))
        cut = hot.where(F.col("mask").isin([int(np.uint64(m).astype(np.int64)) for m in masks])).select("key")
        cut = F.broadcast(cut) if cut.count() <= BROADCAST_KEYS else cut
        cold = rows.join(cut, "key", "left_anti").select("fp", "key")
        done = cold if done is None else done.unionByName(cold)
        # Two paths can fix the same bits: their shards are one.
        rows = materialize(keyed(dealt(rows.join(cut, "key", "left_semi").select("fp", "mask"), masks).distinct()))


def links(classes: DataFrame, radius: int = 3, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Edges (a, b) of a forest with the components of all links within ``radius``. classes: distinct fingerprints ``fp``."""
    rows = sharded(classes, radius, shard_size)
    # Small shards share a task. Bins are as many as the rows need, so that groups don't grow with the corpus.
    bins = max(BINS, -(-rows.count() // BIN_ROWS))
    return rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInPandas(lambda pdf: search_shards(radius)(pdf), "a long, b long")


BINS, BIN_ROWS, BROADCAST_KEYS = 64, 1 << 16, 1_000_000


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, radius: int = 3, shard_size: int = SHARD_SIZE,
    keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: ``id_col``, ``keep``, ``fp``, ``component_fp`` (one fingerprint that names the component) and ``component_id``, the smallest id reachable over links."""
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__keep_{k}") for k, c in enumerate(keep)])
    printed = materialize(fingerprints(named, "__text", words).drop("__text"))
    classes = materialize(printed.groupBy("fp").agg(F.min("__id").alias("least_id"), F.count("*").alias("n")))
    rooted = components(links(classes.select("fp"), radius, shard_size))
    total = classes.agg(F.count("*"), F.sum("n")).first()
    rooted = materialize(rooted.join(classes, rooted["node"] == classes["fp"]).select("fp", "root", "least_id"))
    roots = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_root = join_counted(rooted.select("fp", "root"), roots, ["root"], total[0])
    of_class = classes.join(of_root, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("component_fp"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = join_counted(printed, of_class, ["fp"], total[1] or 0)
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__keep_{k}").alias(c) for k, c in enumerate(keep)], "fp", "component_fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
