"""Ranked lexical search: a block-max index in shards of documents, searched by MaxScore.

Building. Each task cuts its documents into shards of at most ``SHARD_TERMS`` terms or ``SHARD_DOCS`` documents (a longer document is a shard of its
own), so texts are never shuffled. A shard is one row with its documents and one row per term: the posting list as differences of document numbers, two
bytes each, and frequencies, at the width that the shard needs, in blocks of ``BLOCK`` postings; for every block its last document and the largest impact in it, for the list the
largest impact of all. Impacts need two numbers of the whole table, documents and terms, which a first pass counts.

Searching. Only lists that some item asks for are kept; each carries its weight and the items that ask for it, and meets the other lists of its shard
in one group. There an item's lists are ordered by their bound. Lists whose bounds together stay below the lowest score in the item's full heap are non-essential:
only documents in the other lists become candidates, a window of documents at a time. A candidate whose score so far and whose block
maxima on the non-essential lists don't reach the heap's lowest score is rejected before any of those blocks is unpacked; what is left is completed list by list,
largest bound first, with the same test in between. The heaps of all shards are merged by rank. Scores are whole numbers; the result is exact.

Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. Texts that are null, empty or without a term
aren't counted and don't rank. Each row is a document of its own, also where ids repeat; equal scores go by ascending id, rows without an id last.
Rows with one item id, null included, are one item with the terms of its different texts; an item without terms has no rows. Empty tables give no rows.
Extra columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_TERMS, SHARD_DOCS, BLOCK, WINDOW, PIECE = 4_000_000, 32_768, 128, 4096, 1 << 22
ITEMS_AT_ONCE = 2_000
WIDTHS = (np.uint8, np.uint16, np.uint32)
INDEX = "shard long, term string, df long, top long, gaps binary, tfs binary, lasts binary, maxima binary, ids array<long>, m binary"
SCHEMA = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("top", pa.int64()), ("gaps", pa.binary()), ("tfs", pa.binary()),
    ("lasts", pa.binary()), ("maxima", pa.binary()), ("ids", pa.list_(pa.int64())), ("m", pa.binary()),
])
#: Bytes of a text to bytes of its terms: A-Z lower-cased, what separates terms a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[len(data) // n // 2])


def sliced(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of an array as binary values; ``ends`` begins with 0."""
    offsets = (ends * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Builder:
    """The shard that a task is filling."""

    def __init__(self, n_docs: int, n_terms: int, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS):
        self.n_docs, self.n_terms, self.shard_docs, self.shard_terms = n_docs, n_terms, shard_docs, shard_terms
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.lengths, self.numbers, self.held = [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        n = 0
        for terms in terms_of(text):
            self.numbers.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms)))
            n += len(terms)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.held += n

    def full(self) -> bool:
        return self.held >= self.shard_terms or len(self.ids) >= self.shard_docs

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.int64)
        m = 25 + 75 * lengths * self.n_docs // self.n_terms
        key, tf = np.unique((np.concatenate(self.numbers).astype(np.int64) << 32) | np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        term, doc = key >> 32, key & 0xFFFFFFFF
        worth = impacts(tf, m[doc])
        first = np.concatenate([[True], term[1:] != term[:-1]])
        starts = np.flatnonzero(first)
        ends = np.append(starts, len(term))
        df = np.diff(ends)
        gaps = np.where(first, doc, doc - np.concatenate([[0], doc[:-1]])).astype(np.uint16)
        opens = np.flatnonzero((np.arange(len(term)) - np.repeat(starts, df)) % BLOCK == 0)
        maxima = np.maximum.reduceat(worth, opens).astype(np.int32)
        lasts = doc[np.append(opens[1:], len(term)) - 1].astype(np.int32)
        blocks = np.searchsorted(opens, ends)
        tfs = tf.astype(next(w for w in WIDTHS if tf.max() <= np.iinfo(w).max))
        n, none = len(df), lambda kind: pa.nulls(len(df), kind)
        lists = [
            pa.array(np.full(n, shard)), pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), pa.array(df), pa.array(np.maximum.reduceat(worth, starts)),
            sliced(gaps, ends), sliced(tfs, ends), sliced(lasts, blocks), sliced(maxima, blocks), none(pa.list_(pa.int64())), none(pa.binary()),
        ]
        own = [[shard], [f" {shard}"], [len(lengths)], [0], [None], [None], [None], [None], [self.ids], [m.tobytes()]]
        yield pa.RecordBatch.from_arrays(lists, schema=SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, SCHEMA, strict=True)], schema=SCHEMA)


def table_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents that have a term, and terms in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([sum(map(len, terms_of(x.as_py()))) for x in batch["text"]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["docs", "terms"])

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    found = texts.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The shards' rows; the one that holds a shard's documents has a space and the shard's number for a term. ``size``: of ``table_size``; ``shard_docs`` is
    65,536 at most, for differences have two bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, builder = TaskContext.get().partitionId() << 32, Builder(*size, shard_docs, shard_terms)
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                builder.add(doc_id.as_py(), text.as_py())
                if builder.full():
                    yield from builder.rows(shard)
                    shard += 1
                    builder.clear()
        if builder.ids:
            yield from builder.rows(shard)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return kept.mapInArrow(build, INDEX)


class Postings:
    """A list of a shard, as an item sees it: ``factor`` is the term's weight times its occurrences in the item."""

    def __init__(self, row, m: np.ndarray):
        self.m, self.top, self.n = m, int(row.top), int(row.df)
        self.gaps, self.tfs = unpacked(row.gaps, self.n), unpacked(row.tfs, self.n)
        self.lasts, self.maxima = np.frombuffer(row.lasts, np.int32), np.frombuffer(row.maxima, np.int32).astype(np.int64)
        self.run: tuple[int, tuple] = (-1, ())
        self.opened = 0

    def window(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, impact) of a window, unpacked as one run of blocks; the last window stays for the next item."""
        a, b = np.searchsorted(self.lasts, (lo, hi))
        b = min(b + 1, len(self.lasts))
        self.opened += b - a
        if self.run[0] != lo:
            docs = np.cumsum(self.gaps[a * BLOCK : b * BLOCK], dtype=np.int64) + (self.lasts[a - 1] if a else 0)
            x, y = np.searchsorted(docs, (lo, hi))
            self.run = (lo, (docs[x:y], impacts(self.tfs[a * BLOCK + x : a * BLOCK + y].astype(np.int64), self.m[docs[x:y]])))
        return self.run[1]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each document (the one after the last if there is none), and its largest impact."""
        block = np.searchsorted(self.lasts, docs)
        return block, np.append(self.maxima, 0)[block]

    def at(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impact on each document, 0 where the term doesn't occur: of the blocks in which they lie, each unpacked once."""
        out = np.zeros(len(docs), np.int64)
        real = block < len(self.lasts)
        names, which = np.unique(block[real], return_inverse=True)
        if not len(names):
            return out
        self.opened += len(names)
        places = names[:, None] * BLOCK + np.arange(BLOCK)
        inside = places < self.n
        gaps = np.where(inside, self.gaps[np.minimum(places, self.n - 1)].astype(np.int64), 0)
        before = np.where(names > 0, self.lasts[names - 1], 0)
        held = np.where(inside, gaps.cumsum(1) + before[:, None], 1 << 40).ravel()
        # Blocks follow one another, so their documents are in order, but for the filler of the last.
        found = np.searchsorted(held, docs[real])
        found = np.minimum(found, len(held) - 1)
        hit = held[found] == docs[real]
        tf = self.tfs[np.minimum(places.ravel()[found], self.n - 1)].astype(np.int64)
        out[real] = np.where(hit, impacts(tf, self.m[docs[real]]), 0)
        return out


class Heap:
    """The best of an item in a shard, by score and id; documents without an id come last."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, scores: np.ndarray, docs: np.ndarray, order: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        best = np.lexsort((order[docs], -scores))[: self.k]
        self.scores, self.docs = scores[best], docs[best]
        if len(best) == self.k:
            self.least = int(self.scores[-1])


def search_window(lists: list[tuple[int, Postings]], heap: Heap, lo: int, hi: int, order: np.ndarray) -> None:
    """MaxScore over documents ``lo`` to ``hi``. lists: (factor, postings), smallest bound first."""
    prefix = np.cumsum([f * p.top for f, p in lists])
    split = int(np.searchsorted(prefix, heap.least)) if heap.least else 0  # lists before it can't lift a document to the heap's lowest score
    scores = np.zeros(hi - lo, np.int64)
    for f, p in lists[split:]:
        docs, worth = p.window(lo, hi)
        scores[docs - lo] += f * worth
    found = np.flatnonzero(scores)
    score, docs = scores[found], found + lo
    if split and len(docs):
        keep = score + prefix[split - 1] >= heap.least
        score, docs = score[keep], docs[keep]
        blocks, maxima = zip(*[p.bounds(docs) for _, p in lists[:split]], strict=True)
        blocks, maxima = np.array(blocks), np.array(maxima) * np.array([f for f, _ in lists[:split]])[:, None]
        rest = maxima.cumsum(0)
        for i in range(split - 1, -1, -1):
            keep = score + rest[i] >= heap.least
            score, docs, blocks, maxima, rest = score[keep], docs[keep], blocks[:, keep], maxima[:, keep], rest[:, keep]
            if not len(docs):
                break
            asked = maxima[i] > 0
            f, p = lists[i]
            score[asked] += f * p.at(docs[asked], blocks[i][asked])
    good = (score > 0) & (score >= heap.least)
    if good.any():
        heap.add(score[good], docs[good], order)


def search_shard(rows: pd.DataFrame, k: int) -> tuple[list[tuple[int, int | None, int]], int, int]:
    """((item, doc_id, score) of each item's best, blocks that items looked into, blocks of all their lists)."""
    own = rows[rows["m"].notna()]
    if len(own) == len(rows):
        return [], 0, 0
    m, ids = np.frombuffer(own["m"].iloc[0], np.int64), [None if pd.isna(x) else int(x) for x in own["ids"].iloc[0]]
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
    asked: dict[int, list] = defaultdict(list)
    every = []
    for row in rows[rows["m"].isna()].itertuples():
        p = Postings(row, m)
        every.append(p)
        for q, times in zip(row.items, row.times, strict=True):
            if row.w > 0:
                asked[int(q)].append((int(row.w) * int(times), p))
    lists = {q: sorted(x, key=lambda x: x[0] * x[1].top) for q, x in asked.items()}
    heaps = {q: Heap(k) for q in lists}
    for lo in range(0, len(m), WINDOW):
        for q, x in lists.items():
            search_window(x, heaps[q], lo, min(lo + WINDOW, len(m)), order)
    best = [(q, ids[d], int(s)) for q, h in heaps.items() for s, d in zip(h.scores, h.docs, strict=True)]
    return best, sum(p.opened for p in every), sum(len(p.lasts) for x in lists.values() for _, p in x)


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(q, item_id, term, times): what each item asks for; ``q`` is a number for the item."""
    texts = items.select(F.col(id_col).alias("item_id"), ascii_lower(F.col(text_col)).alias("text")).distinct()
    said = texts.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    numbered = said.groupBy("item_id").agg(F.collect_list(F.struct("term", "times")).alias("asks")).select(F.monotonically_increasing_id().alias("q"), "item_id", "asks")
    return materialize(numbered).select("q", "item_id", F.inline("asks"))


def search(index: DataFrame, n_docs: int, asks: DataFrame, k: int = 10, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item. asks: of ``items_of``. The number of items comes to the driver.

    Items go in blocks of about ``items_at_once``; each block meets each shard in a group of its own, which holds the lists that the block asks for.
    """
    n_blocks = -(-asks.select("q").distinct().count() // items_at_once)
    terms = asks.select("term").distinct().withColumn("asked", F.lit(True))
    wanted = materialize(index.join(terms, "term", "left").where(F.col("asked") | F.col("m").isNotNull()).drop("asked"))
    lists = wanted.where("m is null")
    df = lists.groupBy("term").agg(F.sum("df").alias("total"))
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("total") + 1))).alias("w")
    grouped = asks.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(n_blocks, 1)))).groupBy("term", "block").agg(F.collect_list(F.struct("q", "times")).alias("a"))
    weighed = grouped.join(df, "term").select("term", "block", w, F.col("a.q").alias("items"), F.col("a.times").alias("times"))
    none = F.lit(None)
    docs = wanted.where("m is not null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks, 1) - 1).cast("long"))))
    docs = docs.withColumns({"w": none.cast("long"), "items": none.cast("array<long>"), "times": none.cast("array<long>")})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _, _ = search_shard(pdf, k)
        return pd.DataFrame(found, columns=["q", "doc_id", "score"]).astype({"doc_id": "Int64"})

    met = lists.join(weighed, "term").unionByName(docs)
    found = met.groupBy("shard", "block").applyInPandas(best, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asks.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index and search in one go."""
    size = table_size(docs)
    return search(build_index(docs, size), size[0], items_of(items), k)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS terms FROM documents
), posting AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) GROUP BY r, term
), size AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM doc WHERE len(terms) > 0
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, size GROUP BY term
), length AS (
  SELECT r, doc_id, 25 + (75 * len(terms) * n) // l AS m FROM doc, size WHERE len(terms) > 0
), ask AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM ask JOIN weight USING (term) JOIN posting USING (term) JOIN length USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
