"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a schedule over training time 0 to 1: piecewise linear between knots. The integral of the schedule is
the source's demand up to a time. Targets share the whole budget by total weight; none exceeds ``max_repeats`` times its
source's size and the excess is shared again by weight until none is above. Each source lays its documents out by
``md5(doc_id)``, pass after pass, along its own cumulative words; a document's training position is the time at which the
inverted cumulative demand reaches it. Documents are then range-sorted by position.

The running sums go in two levels, so that no source meets in one task: words per (source, leading hash digits), then
inside each such cell. Words of null texts count 0 and null sources are one source, the last. Equal rows are separate
documents; ties of the hash order are broken by id, size and then don't matter. Documents without an id are laid out by the hash of their text.
A source without words has target 0. Columns besides the named ones come along only with ``keep``. An empty table stays empty.
The table of sources (one row each) and one source's row per cell are the only things handled in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

CELL_DIGITS = 3
KNOT = "array<struct<t:double,w:double>>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): water-filling in whole numbers, one division at the end.

    Sources in order of the cap's pressure ``max_repeats * size / weight`` fill up one by one; the first whose cap is above
    the level that the rest would share ends it.
    """
    named = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("long"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    run = ranked.select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("used"), F.sum("source_size").over(everyone).alias("all_size"),
        F.sum("weight").over(everyone).alias("all_weight")
    )
    # The level if exactly the sources before this one are full, as a fraction num / den.
    run = run.withColumn("num", F.col("all_size") - max_repeats * F.col("full")).withColumn("den", F.col("all_weight") - F.col("used"))
    run = run.withColumn("open", max_repeats * F.col("source_size") * F.col("den") > F.col("num") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct("used", "num", "den"))).over(everyone)
    run = run.withColumn("level", level)
    capped = F.col("level").isNull() | (F.col("used") < F.col("level.used"))
    target = F.when(capped, (max_repeats * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den").cast("double")
    )
    return run.select("source", "source_size", "weight", target.alias("target"))


def demand_inverse(share: Column, knots: Column) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``share`` (0 to 1) of its whole.

    Weights are taken as at least 1e-9, so that the integral rises everywhere.
    """
    w = lambda k: F.greatest(k["w"], F.lit(1e-9))
    pairs = F.zip_with(
        F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1),
        lambda a, b: F.struct(a["t"].alias("t0"), w(a).alias("w0"), (b["t"] - a["t"]).alias("dt"), w(b).alias("w1"))
    )
    area = lambda s: s["dt"] * (s["w0"] + s["w1"]) / 2
    whole = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + area(s))

    def step(acc: Column, s: Column) -> Column:
        slope = (s["w1"] - s["w0"]) / s["dt"]
        rest = F.least(acc["rest"], area(s))
        # w0 x + slope x^2 / 2 = rest, in the form that holds for slope 0 too.
        x = 2 * rest / (s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * rest, F.lit(0.0))))
        inside = acc["rest"] >= 0
        return F.struct(
            F.when(inside, s["t0"] + F.least(x, s["dt"])).otherwise(acc["time"]).alias("time"),
            F.when(inside & (acc["rest"] > area(s)), acc["rest"] - area(s)).otherwise(F.lit(-1.0)).alias("rest")
        )

    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("time"), (share * whole).alias("rest")), step, lambda acc: acc["time"])


def curriculum(weight: Column) -> Column:
    """The default schedules: heavy sources fade a little, light ones rise; each keeps its total weight."""
    tilt = F.when(weight >= 5, F.lit(-0.25)).when(weight <= 1, F.lit(0.25)).otherwise(F.lit(0.0))
    return F.array(
        F.struct(F.lit(0.0).alias("t"), (weight * (1 - tilt)).cast("double").alias("w")),
        F.struct(F.lit(1.0).alias("t"), (weight * (1 + tilt)).cast("double").alias("w"))
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, schedule=curriculum, whole_documents: bool = False,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken (words, repeats counted), full_passes, part (words of the last pass) and start_position.

    The last pass of a source ends where its target is reached: the document there is taken in part, or, with
    ``whole_documents``, as a whole if at least half of it is due. ``keep``: more columns to carry along.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.when(F.col(id_col).isNull(), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("nameless"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep]
    )
    sized = sized.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("nameless")))).withColumn("cell", F.substring("order", 1, CELL_DIGITS))
    if not keep:
        sized = materialize(sized)  # slim rows: the texts are read once
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before_cell = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before_cell), F.lit(0)))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_repeats)
    starts = cells.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "cell_start", "source_size", "weight", "target"
    )
    inside = Window.partitionBy("source", "cell").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    due = F.round("target").cast("long")
    at = F.col("cell_start") + F.col("in_cell")
    laid = laid.withColumn("at", at).withColumn("full_passes", F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = due - F.col("full_passes") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("at"), F.lit(0)), F.col("size"))
    if whole_documents:
        part = F.when((part * 2 >= F.col("size")) & (part > 0), F.col("size")).otherwise(F.lit(0))
    laid = laid.withColumn("part", part.cast("long")).withColumn("taken", F.col("full_passes") * F.col("size") + F.col("part"))
    share = F.when(F.col("target") > 0, F.least(F.col("at") / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return laid.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "full_passes", "part", "weight", "at",
        demand_inverse(share, schedule(F.col("weight"))).alias("start_position"), *[F.col(f"__keep_{c}").alias(c) for c in keep]
    )


def training_order(plan: DataFrame, schedule=curriculum) -> DataFrame:
    """Each taken pass of each document as a row with ``copy`` (from 0), ``words`` and ``position``, range-sorted by position.

    Empty documents (size 0) are taken once for each full pass.
    """
    copies = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("full_passes").cast("int"))).alias("copy"))
    copies = copies.withColumn("words", F.when(F.col("copy") < F.col("full_passes"), F.col("size")).otherwise(F.col("part")))
    copies = copies.where((F.col("copy") < F.col("full_passes")) | (F.col("part") > 0))
    share = F.when(F.col("target") > 0, F.least((F.col("at") + F.col("copy") * F.col("source_size")) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return copies.withColumn("position", demand_inverse(share, schedule(F.col("weight")))).orderBy("position", "source", "at", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    plan = plan_mix(table(spark, sf_dir, "documents"))
    position = F.round("start_position", 9).alias("position")
    return plan.orderBy("start_position", "source", "at", "doc_id").select("doc_id", "size", "source_size", "target", "taken", position)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS h FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1)::INT] AS weight FROM per
), run AS (
  SELECT *, coalesce(sum(source_size) OVER b, 0)::BIGINT AS filled, coalesce(sum(weight) OVER b, 0)::BIGINT AS used,
         (sum(source_size) OVER ())::BIGINT AS all_size, (sum(weight) OVER ())::BIGINT AS all_weight
  FROM named WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT *, all_size - 3 * filled AS num, all_weight - used AS den FROM run
), stop AS (
  SELECT used, num, den FROM lev WHERE 3 * source_size * den > num * weight ORDER BY used LIMIT 1
), targets AS (
  SELECT l.source, l.source_size, l.weight, CASE WHEN s.used IS NULL OR l.used < s.used THEN (3 * l.source_size)::DOUBLE ELSE (l.weight * s.num)::DOUBLE / s.den::DOUBLE END AS target
  FROM lev l LEFT JOIN stop s ON true
), laid AS (
  SELECT d.*, t.source_size, t.target, t.weight, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), curve AS (
  SELECT *, weight * (1 - CASE WHEN weight >= 5 THEN -0.25 WHEN weight <= 1 THEN 0.25 ELSE 0.0 END)::DOUBLE AS w0, weight * (1 + CASE WHEN weight >= 5 THEN -0.25 WHEN weight <= 1 THEN 0.25 ELSE 0.0 END)::DOUBLE AS w1,
         CASE WHEN target > 0 THEN least(begun / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS share
  FROM laid
), demand AS (
  SELECT *, w1 - w0 AS slope, share * ((w0 + w1) / 2) AS rest FROM curve
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * size
   + least(greatest(round(target)::BIGINT - CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * source_size - begun, 0), size))::BIGINT AS taken,
  round(least(2 * rest / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * rest, 0.0::DOUBLE))), 1.0::DOUBLE), 9) AS position
FROM demand
"""
