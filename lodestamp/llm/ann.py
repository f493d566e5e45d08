"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree has two storeys. The upper one is fitted in numpy on at most ``max_sample`` vectors chosen by hash and travels to every task; its leaves
are called cells and grow with the table. A cell of more than ``REFINE`` leaves' rows gets a tree of its own, fitted by a task on at most about ``max_sample``
of the cell's vectors; these trees are rows of a table and are only read where their cell is searched. So a leaf holds about ``leaf`` rows, and never more than
``REFINE`` times as many, until all cells hold ``max_sample`` vectors (some ten million rows with the defaults), unless near-equal vectors can't be told apart.
Every vector is routed to its leaf and indexed. A query walks both storeys with a priority queue of unexplored branches, nearest
centre first. How many cells, and how many leaves of a cell, are visited is calibrated: ``calibration`` queries are compared with all vectors,
and both numbers widen until ``target_recall`` of their true neighbours is reached. Those numbers are a mean: each query goes on until
its leaves hold ``k + 1`` ids, and one that is still short because its own id repeats goes on for as many more.

Equal vectors are one point that keeps its ``k + 1`` smallest different ids, each ``k`` times at most: a query's neighbours can't need more of them,
whichever id is its own. Points have names of their own, so the same id may stand at several vectors. Neighbouring leaves are packed into blocks
of bounded size and large ones are cut; a query goes once to each block in which it visits leaves, and is multiplied with the rows of these leaves only.
Queries of a block are cut as well, each pair of blocks being a task's group. Scores are computed in double precision on the original vectors; ties go to the smaller id.

Vectors that are null, empty, zero, or with null or non-finite components take no part, nor do rows with a null id. Of two vectors of different
lengths the shorter one counts as continued with zeros. Rows with a query's own id are no candidates for it; other repeated ids are candidates of their own.
Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize

LOG = logging.getLogger(__name__)
MAX_SAMPLE = 20_000
LEAF, BRANCH = 64, 32
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 5_000, 4_000, 512
#: A cell of more than this many leaves' rows gets a tree of its own.
REFINE = 4
#: Leaves are named across cells as cell * NAMES + leaf.
NAMES = 1 << 24


class Tree:
    """Nodes as arrays: centres, first child and number of children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 5):
        self.centres, self.children, self.leaf_of = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1]
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        work = [(0, sample)]
        while work:
            node, rows = work.pop()
            split = self.split(rows, branch, rng) if len(rows) > leaf else None
            if split is None:
                self.leaf_of[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for centre, part in split:
                self.children[node].append(len(self.centres))
                work.append((len(self.centres), part))
                self.centres.append(centre)
                self.children.append([])
                self.leaf_of.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def split(rows: np.ndarray, branch: int, rng) -> list | None:
        centres = rows[rng.choice(len(rows), min(branch, len(rows)), replace=False)]
        for _ in range(8):
            at = (rows @ centres.T).argmax(1)
            centres = np.stack([unit(rows[at == k].sum(0)[None])[0] if (at == k).any() else centres[k] for k in range(len(centres))])
        at = (rows @ centres.T).argmax(1)
        parts = [(centres[k], rows[at == k]) for k in range(len(centres)) if (at == k).any()]
        return parts if len(parts) > 1 else None

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        rows = as_long_as(rows, self.centres.shape[1])
        out = np.zeros(len(rows), np.int64)
        work = [(0, np.arange(len(rows)))]
        while work:
            node, at = work.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
            elif len(at):
                best = (rows[at] @ self.centres[self.children[node]].T).argmax(1)
                work.extend((child, at[best == k]) for k, child in enumerate(self.children[node]))
        return out

    def leaves(self, query: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Best bin first: the first ``most`` leaves by the priority queue of branches, and more until they hold ``need`` ids (``held``: ids of each leaf)."""
        out, queue, have = [], [(0.0, 0)], 0
        query = as_long_as(query[None], self.centres.shape[1])[0]
        while queue and (len(out) < most or have < need):
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                near = -(self.centres[kids] @ query)
                best = int(near.argmin())
                for k, child in enumerate(kids):
                    if k != best:
                        heapq.heappush(queue, (float(near[k]), child))
                node = kids[best]
            out.append(self.leaf_of[node])
            have += 0 if held is None else int(held[self.leaf_of[node]])
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that no square overflows."""
    rows = rows / np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300)


def as_long_as(rows: np.ndarray, d: int) -> np.ndarray:
    """Rows of length ``d``: cut, or continued with zeros."""
    return rows[:, :d] if rows.shape[1] >= d else np.pad(rows, ((0, 0), (0, d - rows.shape[1])))


def matrix(column) -> np.ndarray:
    """The vectors as rows, the shorter ones continued with zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    d = max((len(v) for v in rows), default=1)
    return np.stack([v if len(v) == d else np.pad(v, (0, d - len(v))) for v in rows]) if rows else np.zeros((0, 1))


def valid(vec: Column) -> Column:
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vec.isNotNull() & ~F.exists(vec, infinite) & F.exists(vec, lambda x: x != 0)


def points(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """Distinct vectors: (point, vec, ids), ids being the k + 1 smallest different ones, each k times at most. Equal vectors never meet beyond those: ranks cut
    each task's part first. ``point`` is a number that holds once the result is written."""
    double = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    clean = vectors.select(F.col(id_col).alias("id"), double.alias("vec")).where(valid(F.col("vec")) & F.col("id").isNotNull()).withColumn("key", F.xxhash64("vec"))
    few = Window.partitionBy("key", "vec").orderBy("id")
    named = clean.groupBy("key", "vec", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    kept = named.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    repeated = F.flatten(F.transform(F.collect_list(F.struct("id", "n")), lambda x: F.array_repeat(x["id"], x["n"])))
    return kept.groupBy("key", "vec").agg(F.array_sort(repeated).alias("ids")).select(F.monotonically_increasing_id().alias("point"), "vec", "ids")


def routed(pts: DataFrame, tree) -> DataFrame:
    """``pts`` with the cell of each vector."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=tree.value.route(unit(matrix(pdf["vec"]))))

    return pts.mapInPandas(route, "point long, vec array<double>, ids array<long>, cell long")


def refined(celled: DataFrame, counts: dict[int, int], leaf: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(``celled`` with ``leaf``, trees): cells of more than ``REFINE * leaf`` rows are cut by trees of their own, others are one leaf, number 0.

    ``counts`` are the rows of each cell. A tree is fitted on all vectors of its cell or on about ``most`` of them, chosen by hash; rows go to it in parts
    of ``BLOCK_ROWS``. The trees are rows (cell, tree).
    """
    spark = celled.sparkSession
    large = [(c, -(-n // BLOCK_ROWS), min(1_000_000, 1_000_000 * most // n)) for c, n in sorted(counts.items()) if n > REFINE * leaf]
    cut = F.broadcast(spark.createDataFrame(large, "cell long, parts long, share long"))
    rest = celled.join(cut, "cell", "left_anti").withColumn("leaf", F.lit(0).cast("long"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(unit(matrix(rows["vec"])), leaf, seed=5 + int(key[0]))
        return pd.DataFrame({"cell": [int(key[0])], "tree": [pickle.dumps(tree)]})

    grain = F.pmod(F.xxhash64(F.lit("cell sample"), "vec"), F.lit(1_000_000))
    drawn = celled.join(cut, "cell").where(grain < F.col("share")).select("cell", "vec")
    trees = materialize(drawn.groupBy("cell").applyInPandas(fit, "cell long, tree binary"))

    def place(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        # A cell of which no vector was drawn stays whole.
        at = pickle.loads(tree["tree"][0]).route(unit(matrix(rows["vec"]))) if len(tree) and len(rows) else 0
        return rows[["point", "vec", "ids", "cell"]].assign(leaf=at)

    parted = celled.join(cut.drop("share"), "cell").withColumn("part", F.pmod(F.xxhash64("point", F.lit("part")), F.col("parts")))
    copies = trees.join(cut.drop("share"), "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    schema = "point long, vec array<double>, ids array<long>, cell long, leaf long"
    placed = parted.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInPandas(place, schema)
    return rest.select("point", "vec", "ids", "cell", "leaf").unionByName(placed), trees


def exact(queries: np.ndarray, rows: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Cosine of pairs, the same for the same two vectors wherever they meet. Where a square would overflow or vanish, the vectors are scaled first."""
    a, b = queries[at], rows[of]
    size = np.stack([np.abs(a).max(1), np.abs(b).max(1)])
    if size.max(initial=1.0) > 1e75 or size.min(initial=1.0) < 1e-75:
        a, b = a / size[0][:, None], b / size[1][:, None]
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def nearest_in_block(
    queries: np.ndarray, rows: np.ndarray, ids: list, m: int, leaf: np.ndarray | None = None, visited: list | None = None
) -> Iterator[tuple[int, int, int, float]]:
    """(query number, row number, id, score) of each query's nearest until ``m`` different ids are among them: matrix products find them, a pairwise sum scores them.

    With ``leaf`` (of each row) and ``visited`` (leaves of each query) a query is multiplied with the rows of leaves it visits only.
    """
    d = max(queries.shape[1], rows.shape[1])
    queries, rows = as_long_as(queries, d), as_long_as(rows, d)
    uq, ur = unit(queries), unit(rows)
    leaf = np.zeros(len(rows), np.int64) if leaf is None else leaf
    visited = [np.zeros(1, np.int64)] * len(queries) if visited is None else visited
    by_leaf = np.argsort(leaf, kind="stable")
    names, starts = np.unique(leaf[by_leaf], return_index=True)
    slices = dict(zip(names.tolist(), np.split(by_leaf, starts[1:]), strict=True))
    for at in range(0, len(uq), AT_ONCE):
        part = visited[at : at + AT_ONCE]
        asking = np.repeat(np.arange(at, at + len(part)), [len(v) for v in part])
        asked = np.concatenate([np.asarray(v, np.int64) for v in part])
        order = np.argsort(asked, kind="stable")
        each, begin = np.unique(asked[order], return_index=True)
        found_q, found_r, found_s = [], [], []
        for name, who in zip(each.tolist(), np.split(asking[order], begin[1:]), strict=True):
            if name in slices:
                here = slices[name]
                near = uq[who] @ ur[here].T
                keep = min(m, len(here))
                floor = np.partition(near, len(here) - keep, axis=1)[:, len(here) - keep] - 1e-9
                i, j = np.nonzero(near >= floor[:, None])
                found_q.append(who[i])
                found_r.append(here[j])
                found_s.append(near[i, j])
        if not found_q:
            continue
        q, r, s = np.concatenate(found_q), np.concatenate(found_r), np.concatenate(found_s)
        order = np.lexsort((-s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        size = np.diff(np.concatenate([first, [len(q)]]))
        floor = s[first + np.minimum(size, m) - 1] - 1e-9
        near = s >= np.repeat(floor, size)
        q, r = q[near], r[near]
        pairs: dict[int, list] = {}
        for i, j, x in zip(q.tolist(), r.tolist(), exact(queries, rows, q, r).tolist(), strict=True):
            pairs.setdefault(i, []).extend((-x, v, j) for v in ids[j])
        for i, some in pairs.items():
            if len({v for _, v, _ in some}) < m:
                # Ids repeat among the nearest rows: this query looks at all rows of its leaves.
                r = np.concatenate([slices[v] for v in set(np.asarray(visited[i]).tolist()) if v in slices])
                some = [(-x, v, j) for j, x in zip(r.tolist(), exact(queries, rows, np.full(len(r), i), r).tolist(), strict=True) for v in ids[j]]
            seen: dict[int, int] = {}
            for x, v, j in sorted(some):
                if len(seen) == m:
                    break
                seen[v] = seen.get(v, 0) + 1
                if seen[v] < m:
                    yield i, j, v, -x


def search_block(m: int):
    def search(key, asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = not len(asking) or not len(rows)
        found = [] if empty else list(
            nearest_in_block(
                matrix(asking["vec"]), matrix(rows["vec"]), [list(x) for x in rows["ids"]], m, rows["leaf"].to_numpy(),
                list(asking["leaves"])
            )
        )
        names, others = asking["point"].to_numpy(), rows["of"].to_numpy()
        cols = {
            "point": [int(names[i]) for i, _, _, _ in found], "of": [int(others[j]) for _, j, _, _ in found],
            "vec_id": [int(v) for _, _, v, _ in found], "score": [float(x) for _, _, _, x in found]
        }
        return pd.DataFrame(cols).astype({"point": "int64", "of": "int64", "vec_id": "int64", "score": "float64"})

    return search


def pack(sizes: dict[int, int], n_leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf: neighbours in the tree share a block until it is full, a large leaf has several of its own."""
    start, parts = np.zeros(n_leaves, np.int64), np.ones(n_leaves, np.int64)
    block, held = 0, 0
    for leaf in range(n_leaves):
        n = sizes.get(leaf, 0)
        if n > BLOCK_ROWS:
            block += held > 0
            start[leaf], parts[leaf] = block, -(-n // BLOCK_ROWS)
            block, held = block + int(parts[leaf]), 0
            continue
        if held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        start[leaf] = block
        held += n
    return start, parts


def described(index: DataFrame, trees: DataFrame, start: np.ndarray) -> DataFrame:
    """(cell, block, tree, leaves) of every cell: the first block of ``start``, the cell's tree (null: one leaf) and of its leaves (leaf, n, ids), the rows and ids they hold."""
    held = index.groupBy("cell", "leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"))
    each = held.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("leaf", "n", "ids"))).alias("leaves"))
    at = index.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(start)], "cell long, block long")
    return each.join(F.broadcast(at), "cell").join(trees, "cell", "left")


def cell_plan(tree: bytes | None, leaves) -> tuple[Tree | None, np.ndarray, np.ndarray, np.ndarray]:
    """(tree, start, parts, held) of a cell: where its leaves lie among its own blocks, and how many ids each holds."""
    of = pickle.loads(tree) if tree is not None else None
    n_leaves = of.n_leaves if of else 1
    start, parts = pack({int(x["leaf"]): int(x["n"]) for x in leaves}, n_leaves)
    held = np.zeros(n_leaves, np.int64)
    for x in leaves:
        held[int(x["leaf"])] = int(x["ids"])
    return of, start, parts, held


def choose(inner: int):
    """A block's queries with the leaves they visit in its cells: (point, vec, block, local, leaves), ``local`` counting the blocks of a large cell."""

    def chosen(key: tuple, asking: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        plans = {int(c): cell_plan(t, x) for c, t, x in zip(cells["cell"], cells["tree"], cells["leaves"], strict=True)}
        out = []
        units = unit(matrix(asking["vec"])) if len(asking) else []
        for point, vec, need, mine, u in zip(asking["point"], asking["vec"], asking["need"], asking["cells"], units, strict=True):
            blocks: dict[int, list] = {}
            for cell in map(int, mine):
                if cell in plans:  # else it is empty
                    tree, start, parts, held = plans[cell]
                    for leaf in tree.leaves(u, inner, held, int(need)) if tree else [0]:
                        for b in range(start[leaf], start[leaf] + parts[leaf]):
                            blocks.setdefault(int(b), []).append(cell * NAMES + leaf)
            out.extend((point, vec, key[0], b, x) for b, x in blocks.items())
        return pd.DataFrame(out, columns=["point", "vec", "block", "local", "leaves"])

    return chosen


def dealt(visiting: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``visiting`` with ``ask_block``, number of these for each key): queries in groups of about ``BLOCK_QUERIES``."""
    asked = visiting.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("n_asked"))
    group = F.pmod(F.xxhash64("point", F.lit("ask")), F.col("n_asked")).cast("int")
    return visiting.join(asked, keys).withColumn("ask_block", group).drop("n_asked"), asked


def copied(df: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """A copy of every row for each group of queries that comes to it."""
    return df.join(asked, keys).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1))).drop("n_asked")


def search(asking: DataFrame, index: DataFrame, cells: DataFrame, tree, start: np.ndarray, ids: np.ndarray, visits: tuple[int, int], m: int) -> DataFrame:
    """(point, of, vec_id, score): each asked point's nearest up to ``m`` different ids of every block it goes to; its leaves hold ``need`` ids at least.

    ``visits``: cells, and leaves of each. ``start`` and ``ids``: first block and number of ids of each cell.
    """
    places = asking.sparkSession.sparkContext.broadcast((start, ids))
    outer, inner = visits

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, ids = places.value
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part, out = pdf.iloc[at : at + 200], []
                for point, vec, need, u in zip(part["point"], part["vec"], part["need"], unit(matrix(part["vec"])), strict=True):
                    blocks: dict[int, list] = {}
                    for cell in tree.value.leaves(u, outer, ids, int(need)):
                        blocks.setdefault(int(start[cell]), []).append(cell)
                    out.extend((point, vec, need, b, x) for b, x in blocks.items())
                yield pd.DataFrame(out, columns=["point", "vec", "need", "block", "cells"])

    schema = "point long, vec array<double>, need long, block long, cells array<long>"
    visiting = materialize(asking.select("point", "vec", "need").repartition("point").mapInPandas(order, schema))
    visiting, asked = dealt(visiting, ["block"])
    keys = ["block", "ask_block"]
    chosen = visiting.groupBy(*keys).cogroup(copied(cells, asked, ["block"]).groupBy(*keys))
    visiting = materialize(chosen.applyInPandas(choose(inner), "point long, vec array<double>, block long, local long, leaves array<long>"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, block, leaves in zip(pdf["cell"], pdf["block"], pdf["leaves"], strict=True):
                sizes = {int(x["leaf"]): int(x["n"]) for x in leaves}
                known = list(sizes)
                first, parts = pack(sizes, max(known) + 1)
                yield pd.DataFrame({"cell": cell, "leaf": known, "block": block, "first": first[known], "parts": parts[known]})

    at = cells.select("cell", "block", "leaves").mapInPandas(place, "cell long, leaf long, block long, first long, parts long")
    local = F.col("first") + F.pmod(F.xxhash64("point", F.lit("row")), F.col("parts"))
    name = (F.col("cell") * NAMES + F.col("leaf")).alias("leaf")
    rows = index.join(at, ["cell", "leaf"]).select(F.col("point").alias("of"), "vec", "ids", name, "block", local.alias("local"))
    keys = ["block", "local"]
    visiting, asked = dealt(visiting, keys)
    rows, keys = copied(rows, asked, keys), [*keys, "ask_block"]
    found = visiting.groupBy(*keys).cogroup(rows.groupBy(*keys))
    return found.applyInPandas(search_block(m), "point long, of long, vec_id long, score double")


def best(found: DataFrame, m: int) -> DataFrame:
    """The ``m`` best of each point."""
    w = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def answered(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Each query id's ``k`` best rows, its own id left out before they are ranked. They are rows of the ``k + 1`` ids that are nearest to one of its points, ``k`` of an id at most."""
    rows = found.groupBy("point", "of", "vec_id").agg(F.max("score").alias("score"), F.count("*").alias("times"))
    of_id = Window.partitionBy("point", "vec_id")
    rows = rows.withColumn("top", F.max("score").over(of_id)).withColumn("r", F.row_number().over(of_id.orderBy(F.desc("score"), "of"))).where(F.col("r") <= k)
    ids = Window.partitionBy("point").orderBy(F.desc("top"), "vec_id")
    few = rows.withColumn("r", F.dense_rank().over(ids)).where(F.col("r") <= k + 1).select("point", "of", "vec_id", "score", "times")
    of_point = asked.groupBy("point").agg(F.count("*").alias("n"))
    answers = join_counted(asked.select("query_id", "point"), few.join(of_point, "point"), ["point"], asked.count()).where(F.col("vec_id") != F.col("query_id"))
    once = answers.groupBy("query_id", "of", "vec_id").agg(F.max("score").alias("score"), F.max("times").alias("times"))
    each = once.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, cells: DataFrame, tree, m: int, calibration: int, target: float) -> tuple[tuple[int, int], float]:
    """((cells to visit, leaves to visit in a cell), recall on the calibration queries): true neighbours from all points, block by block, then the cells and leaves in which they lie."""
    few = index.orderBy(F.xxhash64(F.lit("calibration"), "vec"), "point").limit(calibration).select("point", "vec").toPandas()
    if not len(few):
        return (1, 1), 1.0
    shared = index.sparkSession.sparkContext.broadcast((few["point"].to_numpy(), matrix(few["vec"])))
    schema = "point long, vec_id long, score double, cell long, leaf long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = shared.value
        for pdf in batches:
            if len(pdf):
                place = dict(zip(pdf["point"], zip(pdf["cell"], pdf["leaf"], strict=True), strict=True))
                near = nearest_in_block(queries, matrix(pdf["vec"]), [[p] for p in pdf["point"]], m + 1)
                found = [(int(names[i]), int(v), float(s), *map(int, place[v])) for i, _, v, s in near if v != names[i]]
                yield pd.DataFrame(found, columns=["point", "vec_id", "score", "cell", "leaf"])

    truth = materialize(best(index.select("point", "vec", "cell", "leaf").mapInPandas(scan, schema), m))

    def ranked(key: tuple, near: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        names, queries = shared.value
        at = {int(p): i for i, p in enumerate(names)}
        of = cell["tree"][0] if len(cell) else None
        sub = pickle.loads(of) if of is not None else None
        rank = [sub.leaves(unit(queries[[at[p]]])[0], sub.n_leaves).index(x) + 1 if sub else 1 for p, x in zip(near["point"], near["leaf"], strict=True)]
        return pd.DataFrame({"point": near["point"], "cell": near["cell"], "inner": rank})

    # A task holds one cell's tree at a time.
    of_cell = truth.select("point", "cell", "leaf").groupBy("cell").cogroup(cells.select("cell", "tree").groupBy("cell"))
    true = of_cell.applyInPandas(ranked, "point long, cell long, inner long").toPandas()
    if not len(true):
        return (1, 1), 1.0
    ranks = {int(p): {cell: r for r, cell in enumerate(tree.value.leaves(v, tree.value.n_leaves))} for p, v in zip(few["point"], unit(matrix(few["vec"])), strict=True)}
    outer = np.array([ranks[int(p)][int(c)] + 1 for p, c in zip(true["point"], true["cell"], strict=True)])
    inner = true["inner"].to_numpy()

    def widened(needed: np.ndarray, share: float) -> int:
        visits = 1
        while np.mean(needed <= visits) < share:
            visits += max(1, visits // 8)
        return min(visits, int(needed.max()))

    # Where cells have leaves of their own, both storeys lose alike.
    cells_seen = widened(outer, target if (inner == 1).all() else target**0.5)
    leaves_seen = widened(np.where(outer <= cells_seen, inner, inner.max() + 1), target) if np.mean(outer <= cells_seen) > target else int(inner.max())
    return (cells_seen, leaves_seen), float(np.mean((outer <= cells_seen) & (inner <= leaves_seen)))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, target_recall: float = 0.95, max_sample: int = MAX_SAMPLE, calibration: int = 200,
    leaf: int = LEAF, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest other rows of every row for which ``queries`` holds. An id that several rows have asks with each of its vectors and has one answer: every other row counts once, with its best score."""
    sc = vectors.sparkSession.sparkContext
    pts = materialize(points(vectors, k, id_col, vec_col))
    n = pts.count()
    grain = F.pmod(F.xxhash64(F.lit("tree sample"), "vec"), F.lit(1_000_000))
    sample = pts.select("vec").where(grain < (1_000_000 * max_sample // n if n > max_sample else 1_000_000)).toPandas()
    tree = sc.broadcast(Tree(unit(matrix(sample["vec"])) if len(sample) else np.zeros((0, 1)), leaf))
    celled = materialize(routed(pts, tree))
    # Two counts for each cell of the upper storey come to the driver.
    counted = celled.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    sizes, ids = {r["cell"]: r["n"] for r in counted}, np.zeros(tree.value.n_leaves, np.int64)
    for r in counted:
        ids[r["cell"]] = r["ids"]
    start, _ = pack(sizes, tree.value.n_leaves)
    index, trees = refined(celled, sizes, leaf, max_sample)
    index = materialize(index)
    cells = materialize(described(index, trees, start))
    visits, recall = calibrate(index, cells, tree, k, calibration, target_recall)
    LOG.info("%d cells, %d leaves of each visited: recall %.3f on calibration queries", *visits, recall)
    double = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    asked = vectors.where(queries).select(F.col(id_col).alias("query_id"), double.alias("vec")).where(valid(F.col("vec")) & F.col("query_id").isNotNull())
    asked = materialize(asked.distinct().withColumn("key", F.xxhash64("vec")))
    counted = asked.groupBy("key", "vec").agg(F.count("*").alias("n"))
    named = pts.select("point", "vec").withColumn("key", F.xxhash64("vec")).join(counted, ["key", "vec"])
    asked = materialize(join_counted(asked, named, ["key", "vec"], asked.count()).select("query_id", "point", "vec").withColumn("need", F.lit(k + 1)))
    one = lambda q: q.groupBy("point", "vec").agg(F.max("need").alias("need"))
    answers = materialize(answered(asked, search(one(asked), index, cells, tree, start, ids, visits, k + 1), k))
    full = answers.where(F.col("rank") == k).select("query_id")
    short = materialize(asked.drop("need").join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return answers
    # As many ids more as the index has of the query's own.
    own = index.select(F.explode("ids").alias("query_id")).join(short.select("query_id").distinct(), "query_id").groupBy("query_id").agg(F.count("*").alias("own"))
    short = materialize(short.join(own, "query_id", "left").withColumn("need", F.coalesce("own", F.lit(0)) + k).drop("own"))
    wider = answered(short, search(one(short), index, cells, tree, start, ids, visits, k + 1), k)
    return answers.join(full, "query_id", "left_semi").unionByName(wider)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
