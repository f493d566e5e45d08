"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

``vnodes`` points of every shard lie on a ring of 60-bit positions; a document's key (its id) falls on the arc that ends at the next point clockwise and belongs to
that point's shard. Each shard has a capacity. An arc offers its documents, in order of position, to its own shard; what a full shard doesn't take
goes on clockwise to the next shard's point, and on again, until it has been taken: in the k-th step every arc asks the k-th different shard
after it, arcs in ring order. Capacities add up to the whole load at least, so all documents are placed after as many steps as there are shards.

Capacities: with ``by="rows"`` and ``slack=0`` (the query) counts differ by one at most. With a slack of, say, 0.05 a shard may hold 5 % more than its share and fewer
documents move when a shard joins or leaves. With ``by="bytes"`` loads are bytes; a document is of the shard in whose part of the arc it begins, so a shard exceeds its capacity
by less than a document for each part it ends in.

Work in Spark: documents become slim rows once; loads are summed per arc and, for running sums, per cell of the ring (about ``CELL_ROWS`` rows). Cells that
one key makes larger than a ten thousandth of the table are dealt into parts by row. Only the arcs' loads, ``shards * vnodes`` numbers whatever the table holds,
come to the driver, where the steps run; the pieces of arcs that result go back as a broadcast of the same order of size.

A null text has no bytes and counts as empty. Documents without an id are placed by the hash of their text; rows with equal ids have one position and are
neighbours on it, but each row is placed on its own, so that repeats may end in several shards. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS, VNODES = 8, 128
CELL_ROWS, HOT_CELLS = 50_000, 10_000
DIGITS = 15  # hexadecimal digits of a position


def position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:DIGITS], 16)


class Ring:
    """Sorted points and the shard of each."""

    def __init__(self, shards: int = SHARDS, vnodes: int = VNODES):
        points = sorted((position(f"shard {s} {v}"), s) for s in range(shards) for v in range(vnodes))
        self.points, self.owners, self.shards = np.array([p for p, _ in points], np.int64), [s for _, s in points], shards

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        """The arc of each position: the number of the first point at or after it, the first point after the last."""
        return np.searchsorted(self.points, positions) % len(self.points)

    def clockwise(self) -> list[list[int]]:
        """For each arc the different shards in the order of their next points."""
        out: list[list[int]] = [[]] * len(self.owners)
        order = list(dict.fromkeys(self.owners))  # of the arc after the last
        for arc in range(len(self.owners) - 1, -1, -1):
            s = self.owners[arc]
            order = [s, *(x for x in order if x != s)]
            out[arc] = order
        return out

    def placed(self, loads: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int]]:
        """(arc, from, to, shard): which part of each arc's load goes where."""
        order, rest, begun, free, out = self.clockwise(), loads.tolist(), [0] * len(loads), list(capacity), []
        for step in range(self.shards):
            for arc in range(len(rest)):
                shard = order[arc][step]
                taken = min(rest[arc], free[shard])
                if taken > 0:
                    out.append((arc, begun[arc], begun[arc] + taken, shard))
                    begun[arc], rest[arc], free[shard] = begun[arc] + taken, rest[arc] - taken, free[shard] - taken
        return out


def capacities(load: int, shards: int, slack: float) -> list[int]:
    """Of equal shares; without slack they add up to the load exactly."""
    if slack <= 0:
        return [load // shards + (s < load % shards) for s in range(shards)]
    return [int(-(-load * (1 + slack) // shards))] * shards


def arc_of(ring: Ring, at: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def arc(positions: pa.Array) -> pa.Array:
        return pa.array(ring.arcs(positions.to_numpy(zero_copy_only=False)).astype(np.int32))

    return arc(at)


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, by: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row per document; slots count a shard's rows from 0 in ring order. The number of rows, the
    whole load and the load of each arc come to the driver."""
    ring, text = Ring(shards, vnodes), F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text)))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    slim = slim.withColumn("at", F.conv(F.substring(F.md5("key"), 1, DIGITS), 16, 10).cast("long")).withColumn("arc", arc_of(ring, F.col("at")))
    slim = materialize(slim).withColumn("row", F.monotonically_increasing_id())
    n = slim.count()
    bits = max(0, (n // CELL_ROWS).bit_length())
    slim = slim.withColumn("cell", F.shiftright("at", 4 * DIGITS - bits)).withColumn("load", F.lit(1).cast("long") if by == "rows" else F.col("size"))
    cells = slim.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    most = max(n // HOT_CELLS, CELL_ROWS)
    hot = materialize(cells.where(F.col("n") > most).select("arc", "cell", F.ceil(F.col("n") / most).alias("parts")))
    slim = slim.join(F.broadcast(hot), ["arc", "cell"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0).cast("long")))

    group = ["arc", "cell", "part"]
    loads = materialize(slim.groupBy(*group).agg(F.sum("load").alias("n")))
    before = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = loads.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    total = np.zeros(len(ring.points), np.int64)
    for row in loads.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        total[row["arc"]] = row["n"]
    pieces = ring.placed(total, capacities(int(total.sum()), shards, slack))
    pieces = docs.sparkSession.createDataFrame(pieces, "arc int, begin long, end long, shard int").groupBy("arc").agg(
        F.collect_list(F.struct("begin", "end", "shard")).alias("pieces")
    )

    order = Window.partitionBy(*group).orderBy("at", "key", "size", "text_crc32", "row")
    mine = F.col("start") + F.coalesce(F.sum("load").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slim.join(starts, group).join(F.broadcast(pieces), "arc").withColumn("mine", mine)
    piece = F.filter("pieces", lambda p: (p["begin"] <= F.col("mine")) & (F.col("mine") < p["end"]))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", *group, "at", "key", "row", piece[0]["shard"].alias("shard")))

    held = placed.groupBy("shard", *group).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", *group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", *group).orderBy("at", "key", "size", "text_crc32", "row")
    slotted = placed.join(held, ["shard", *group]).withColumn("slot", F.col("ahead") + F.row_number().over(inside) - 1)
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql(shards: int = SHARDS, vnodes: int = VNODES) -> str:
    """The same steps. CRC-32 goes byte by byte."""
    steps, n = [], shards * vnodes
    for k in range(shards):
        steps.append(f"""t{k} AS (SELECT arc, rest, begun, s, greatest(least(rest, free - coalesce(sum(rest) OVER (PARTITION BY s ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS taken
  FROM l{k} JOIN pref USING (arc) JOIN f{k} USING (s) WHERE k = {k}),
l{k + 1} AS (SELECT arc, rest - taken AS rest, begun + taken AS begun FROM t{k}),
f{k + 1} AS (SELECT s, free - coalesce(sum(taken), 0)::BIGINT AS free FROM f{k} LEFT JOIN t{k} USING (s) GROUP BY s, free)""")
    pieces = " UNION ALL ".join(f"SELECT arc, begun, begun + taken AS until, s FROM t{k} WHERE taken > 0" for k in range(shards))
    rows = ",\n".join(steps)
    return f"""
WITH RECURSIVE crc(b, c, i) AS (
  SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM crc WHERE i < 8
), crcs AS (
  SELECT list(c ORDER BY b) AS t FROM crc WHERE i = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS key FROM documents
), bytes AS (
  SELECT *, hex(encode(text)) AS h FROM d
), sized AS (
  SELECT doc_id, key, length(h) // 2 + 1 AS size, ('0x' || substr(md5(key), 1, {DIGITS}))::BIGINT AS pos,
    xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS text_crc32
  FROM bytes, crcs
), pts AS (
  SELECT row_number() OVER (ORDER BY p, s) - 1 AS i, s, p FROM (SELECT s, ('0x' || substr(md5('shard ' || s || ' ' || v), 1, {DIGITS}))::BIGINT AS p FROM range({shards}) a(s), range({vnodes}) b(v))
), pref AS (
  SELECT a.i AS arc, b.s, row_number() OVER (PARTITION BY a.i ORDER BY min((b.i - a.i + {n}) % {n})) - 1 AS k FROM pts a, pts b GROUP BY a.i, b.s
), placed AS (
  SELECT d.*, coalesce(i, 0) AS arc FROM sized d ASOF LEFT JOIN pts ON d.pos <= pts.p
), l0 AS (
  SELECT arc, count(*) AS rest, 0::BIGINT AS begun FROM placed GROUP BY arc
), f0 AS (
  SELECT s, (SELECT count(*) FROM d) // {shards} + (s < (SELECT count(*) FROM d) % {shards})::INT AS free FROM range({shards}) a(s)
), {rows},
piece AS ({pieces}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, key, size, text_crc32) - 1 AS mine FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, s::INT AS shard,
  row_number() OVER (PARTITION BY s ORDER BY r.arc, pos, key, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM ranked r JOIN piece p ON r.arc = p.arc AND r.mine >= p.begun AND r.mine < p.until
"""


SQL = sql()
