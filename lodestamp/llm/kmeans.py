"""Centroid clustering by Lloyd's rounds, sharded by dimension, in whole numbers.

Vectors are cut into chunks of at most ``CHUNK`` and each chunk into column blocks of ``BLOCK_DIMS`` components; a row (chunk, block) is a task's unit of
work. Centroids are cut into slices along the same blocks. A round:

1. each column block computes the exact partial squared distances of its chunk against the centroid slice of its block;
2. the blocks of a chunk are added by key (chunk) and the smallest sum names the cluster, ties going to the smaller number;
3. the chunk's clusters go back to its column blocks, each task sums components per cluster for the blocks it holds, and each block's sums, with
   their counts, update that block's slice: floor(sum / count), empty clusters keep their values.

Slices are k rows of ``BLOCK_DIMS`` numbers and are written to the checkpoint folder after every round, so a round's plan starts from the matrix and the slices. They are
broadcast while all of them together have at most ``BROADCAST_CELLS`` numbers and joined by shuffle beyond. Nothing else is: neither vectors nor clusters pass the driver.

Components are floor(scale * x) in double precision, held within plus or minus 2^27, so that every distance is exact in 64 bits; inertias that
wouldn't fit are the largest long. Vectors that are null, of another length, or with null or non-finite components take no part. Each row is a vector of
its own, also where ids or vectors repeat; rows without an id are clustered, and start a centroid only where rows with ids are too few. Fewer vectors than
centroids: as many centroids as vectors. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CHUNK, BLOCK_DIMS = 1024, 16
LIMIT = 2**27
BROADCAST_CELLS = 4_000_000
SLICES = "block int, c array<array<long>>"


def whole(vectors: DataFrame, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors that take part, q being whole numbers."""
    vec = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    return vectors.where((F.size(vec) == dim) & ~F.exists(vec, bad)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, number).alias("q"))


def cut(points: DataFrame, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """The matrix: (chunk, block, n, data, ids), a row for each column block of each chunk; ``ids`` stands in the first block only."""

    def cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                rows = np.stack(pdf["q"].iloc[at : at + CHUNK].to_numpy()).astype(np.int32)
                ids = [None if pd.isna(i) else int(i) for i in pdf["vec_id"].iloc[at : at + CHUNK]]
                starts = range(0, rows.shape[1], block_dims)
                data = [np.ascontiguousarray(rows[:, s : s + block_dims]).tobytes() for s in starts]
                yield pd.DataFrame({"chunk": chunk, "block": range(len(data)), "n": len(rows), "data": data, "ids": [ids] + [None] * (len(data) - 1)})
                chunk += 1

    named = points.withColumn("vec_id", F.col("vec_id").cast("decimal(20,0)"))  # whole in pandas beside nulls
    return named.mapInPandas(cut_batches, "chunk long, block int, n int, data binary, ids array<long>")


def first_slices(points: DataFrame, k: int, seed: str, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """(block, c): the slices of the ``k`` vectors whose ids have the smallest hashes, in that order. ``k`` rows meet in one task."""
    ranked = points.select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "q").limit(k)
    numbered = ranked.select("q", F.row_number().over(Window.orderBy(F.asc_nulls_last("h"), "q")).alias("cluster"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("q") - 1) / block_dims).cast("int")), lambda b: F.slice("q", b * block_dims + 1, F.lit(block_dims)))
    rows = numbered.select("cluster", F.posexplode(pieces).alias("block", "piece"))
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "piece")))
    return rows.groupBy("block").agg(F.transform(ordered, lambda x: x["piece"]).alias("c")).select("block", "c")


def matrix_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows: in doubles, which multiply faster, where every sum stays below 2^53."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 2**21 and x.shape[1] <= 256:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def with_slices(matrix: DataFrame, slices: DataFrame, k: int, dim: int) -> DataFrame:
    return matrix.join(F.broadcast(slices) if k * dim <= BROADCAST_CELLS else slices, "block")


def assign(matrix: DataFrame, slices: DataFrame, k: int, dim: int) -> DataFrame:
    """(chunk, ids, clusters, distances): every vector's nearest centroid."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                found = partial_distances(matrix_of(row.data, row.n), np.array([list(v) for v in row.c], np.int64))
                small = found.max(initial=0) < 2**31
                yield pd.DataFrame(
                    {
                        "chunk": [row.chunk], "n": [row.n], "ids": [row.ids], "wide": [not small],
                        "partial": [found.astype(np.int32 if small else np.int64).tobytes()]
                    }
                )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        total = sum(np.frombuffer(p, np.int64 if wide else np.int32).reshape(n, -1).astype(np.int64) for p, wide in zip(pdf["partial"], pdf["wide"], strict=True))
        nearest = total.argmin(1)
        ids = next(x for x in pdf["ids"] if x is not None)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "ids": [ids], "clusters": [nearest.astype(np.int32)], "distances": [total[np.arange(n), nearest]]})

    parts = with_slices(matrix, slices, k, dim).mapInPandas(partial, "chunk long, n int, ids array<long>, wide boolean, partial binary")
    return parts.groupBy("chunk").applyInPandas(add, "chunk long, ids array<long>, clusters array<int>, distances array<long>")


def moved(matrix: DataFrame, assigned: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(block, c): each slice after its block's components have been averaged per cluster."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, np.ndarray] = {}
        for pdf in batches:
            for row in pdf.itertuples():
                x, at = matrix_of(row.data, row.n), np.asarray(row.clusters, np.int64)
                if row.block not in total:
                    total[row.block], count[row.block] = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
                np.add.at(total[row.block], at, x)
                count[row.block] += np.bincount(at, minlength=k)
        for block, x in total.items():
            yield pd.DataFrame({"block": [block], "sums": [x.tobytes()], "counts": [count[block].tobytes()]})

    def update(key, added: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        c = np.array([list(v) for v in old["c"].iloc[0]], np.int64)
        if len(added):
            n = sum(np.frombuffer(x, np.int64) for x in added["counts"])[: len(c)]
            s = sum(np.frombuffer(x, np.int64).reshape(k, -1) for x in added["sums"])[: len(c)]
            c = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c)
        return pd.DataFrame({"block": [key[0]], "c": [c.tolist()]})

    added = matrix.select("chunk", "block", "n", "data").join(assigned.select("chunk", "clusters"), "chunk").mapInPandas(sums, "block int, sums binary, counts binary")
    return added.groupBy("block").cogroup(slices.groupBy("block")).applyInPandas(update, SLICES)


def lloyd(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", block_dims: int = BLOCK_DIMS,
    id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """((chunk, ids, clusters, distances), slices) after ``rounds`` rounds and a last assignment."""
    points = whole(vectors, dim, scale, id_col, vec_col)
    matrix = materialize(cut(points, block_dims).repartition("block", "chunk"))
    slices = materialize(first_slices(points, k, seed, block_dims))
    for _ in range(rounds):
        slices = materialize(moved(matrix, assign(matrix, slices, k, dim), slices, k))
    return materialize(assign(matrix, slices, k, dim)), slices


def centroids(slices: DataFrame) -> DataFrame:
    """(cluster, centroid): the slices put together."""
    rows = slices.select("block", F.posexplode("c").alias("cluster", "piece"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "piece")))
    return rows.groupBy("cluster").agg(F.flatten(F.transform(ordered, lambda x: x["piece"])).alias("centroid"))


def clustered(assigned: DataFrame, slices: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per vector."""
    rows = assigned.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("x")).select(
        F.col("x.ids").alias("vec_id"), F.col("x.clusters").alias("cluster"), F.col("x.distances").alias("distance")
    )
    within = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    summed = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("own"))
    summed = summed.select("cluster", within(F.col("own")).alias("cluster_inertia"), within(F.sum("own").over(Window.partitionBy())).alias("inertia"))
    digest = centroids(slices).select("cluster", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(summed.join(digest, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return clustered(*lloyd(table(spark, sf_dir, "embeddings")))


def sql(rounds: int = 5, k: int = 40) -> str:
    """The same by one row per vector and component."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT r, cluster, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{i} USING (dim) GROUP BY r, cluster),
a{i} AS (SELECT r, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS distance FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, dim, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y FROM v JOIN a{i} USING (r) GROUP BY cluster, dim),
c{i + 1} AS (SELECT cluster, dim, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN m{i} m USING (cluster, dim))""")
    rows = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT r, generate_subscripts(q, 1) AS dim, unnest(q) AS x FROM kept
), start AS (
  SELECT q, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), q) - 1 AS cluster FROM kept QUALIFY cluster < {k}
), c0 AS (
  SELECT cluster::INT AS cluster, generate_subscripts(q, 1) AS dim, unnest(q) AS y FROM start
), {rows},
digest AS (SELECT cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN digest USING (cluster)
"""


SQL = sql()
