"""Geometry of box tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestamp.functions import serial as S

# What counts as one line of text, in heights of its boxes, and the margins of crops, in sizes of the box.
SAME_LINE, GAP_BACK, GAP_AHEAD, PIECES = 0.6, 0.5, 2.0, 4
OVERLAP, FAR = 0.45, 3.0
PAD_SIDE, PAD_ABOVE, PAD_BELOW = 0.35, 0.8, 2.5
CROP_PAD, CROP_BOTTOM = 0.15, 0.90
ROWS_IN_TASK = 500_000


def plausible(df: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Boxes wide enough for a line of text; rows without a box pass."""
    high = F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    return df.where(F.col("x1").isNull() | ((F.col("x2") - F.col("x1")) / high >= ratio))


SIDES = ("x1", "y1", "x2", "y2")
BOX = ("ord", "text", "confidence", *SIDES)
LINE_ITEM = "array<struct<text:string,confidence:double,x1:double,y1:double,x2:double,y2:double,n_boxes:bigint>>"
LINE_TYPE = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), *[(c, pa.float64()) for c in SIDES], ("n_boxes", pa.int64())]))


class Frames:
    """The boxes of many images as matrices, a row per image and a column per box in the order of ``keys``; NaN where an image has no more boxes."""

    def __init__(self, counts: np.ndarray, values: dict[str, np.ndarray], keys: tuple[str, ...]):
        self.n, self.m = len(counts), int(counts.max(initial=0))
        image = np.repeat(np.arange(self.n), counts)
        order = np.lexsort([np.arange(len(image)), *[values[k] for k in reversed(keys)], image])
        self.place = np.full((self.n, self.m), -1, np.int64)
        self.place[image, np.arange(len(image)) - np.repeat(np.cumsum(counts) - counts, counts)] = order
        self.real = self.place >= 0
        pick = lambda v: np.where(self.real, v[self.place], np.nan) if len(v) else np.zeros((self.n, self.m))
        self.side = {c: pick(values[c]) for c in SIDES}


def chains(f: Frames) -> np.ndarray:
    """G1: (image row, column, chain, position) of every box in a chain: the boxes of a line from left to right, the nearest gap first, up to PIECES.

    A sweep over the columns: all images that have a free box there start a chain with it at once, and look for its next box in all of their columns at once.
    """
    free, out = f.real.copy(), []
    x1, y1, x2, y2 = (f.side[c] for c in SIDES)
    for start in range(f.m):
        rows = np.flatnonzero(free[:, start])
        hull = np.stack([v[rows, start] for v in (x1, y1, x2, y2)], 1)
        usable = free[rows]
        usable[:, start] = False
        links = [np.full(len(rows), start)]
        for _ in range(PIECES - 1):
            height = np.maximum(np.maximum(y2[rows] - y1[rows], (hull[:, 3] - hull[:, 1])[:, None]), 1.0)
            gap = x1[rows] - hull[:, 2, None]
            off = np.abs(y1[rows] + y2[rows] - (hull[:, 1] + hull[:, 3])[:, None]) / 2
            with np.errstate(invalid="ignore"):
                fits = usable & (gap >= -GAP_BACK * height) & (gap <= GAP_AHEAD * height) & (off <= SAME_LINE * height)
            gap = np.where(fits, gap, np.inf)
            found = fits.any(1)
            column = np.where(found, gap.argmin(1), -1) if f.m else np.full(len(rows), -1)
            links.append(column)
            usable[~found] = False
            at, won = rows[found], column[found]
            usable[found, won] = False
            for k, (v, widest) in enumerate(((x1, np.minimum), (y1, np.minimum), (x2, np.maximum), (y2, np.maximum))):
                hull[found, k] = widest(hull[found, k], v[at, won])
        joined = np.stack(links, 1)
        several = joined[:, 1] >= 0
        member, position = np.nonzero(joined[several] >= 0)
        at, column = rows[several][member], joined[several][member, position]
        free[at, column] = False
        out.append(np.stack([at, column, np.full(len(at), start), position], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def fragments(f: Frames) -> np.ndarray:
    """(image row, column, line, position) of every box: from the top, each joins the first line with enough common height with its first box that isn't too far away.

    A sweep over the columns: the next boxes of all images are compared with all lines of their images at once.
    """
    line = {c: np.full((f.n, f.m), np.nan) for c in ("top", "bottom", "left", "right")}
    n_lines, out = np.zeros(f.n, np.int64), []
    for column in range(f.m):
        rows = np.flatnonzero(f.real[:, column])
        x1, y1, x2, y2 = (f.side[c][rows, column, None] for c in SIDES)
        top, bottom, left, right = (line[c][rows] for c in ("top", "bottom", "left", "right"))
        common = np.minimum(bottom, y2) - np.maximum(top, y1)
        with np.errstate(invalid="ignore"):
            fits = common >= OVERLAP * np.maximum(np.minimum(bottom - top, y2 - y1), 1.0)
            fits &= np.maximum(x1 - right, left - x2) <= FAR * np.maximum(np.maximum(bottom - top, y2 - y1), 1.0)
        known = fits.any(1)
        to = np.where(known, fits.argmax(1), n_lines[rows])
        new = ~known
        line["top"][rows[new], to[new]], line["bottom"][rows[new], to[new]] = y1[new, 0], y2[new, 0]
        line["left"][rows, to] = np.fmin(line["left"][rows, to], x1[:, 0])
        line["right"][rows, to] = np.fmax(line["right"][rows, to], x2[:, 0])
        n_lines[rows[new]] += 1
        out.append(np.stack([rows, np.full(len(rows), column), to, np.full(len(rows), column)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def lines_of(lists: pa.Array, groups_of, keys: tuple[str, ...], joins_text: bool) -> pa.Array:
    """Lists of boxes, one per image, to lists of lines. Images of similar size share matrices, so that one with many boxes doesn't widen the others."""
    offsets = np.asarray(lists.offsets)
    counts, flat = np.diff(offsets), lists.values
    columns = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in BOX if c != "text"}
    texts = np.array(flat.field("text").to_pylist(), dtype=object) if joins_text else None
    owners, members, sizes = ([np.zeros(0, np.int64)] for _ in range(3))
    width = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for w in np.unique(width[counts > 0]):
        images = np.flatnonzero((width == w) & (counts > 0))
        held = counts[images]
        boxes = np.arange(held.sum()) + np.repeat(offsets[images] - np.cumsum(held) + held, held)
        f = Frames(held, {c: v[boxes] for c, v in columns.items()}, keys)
        found = groups_of(f)
        if not len(found):
            continue
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], (found[1:, [0, 2]] != found[:-1, [0, 2]]).any(1)]))
        owners.append(images[found[new, 0]])
        members.append(boxes[f.place[found[:, 0], found[:, 1]]])
        sizes.append(np.diff(np.r_[new, len(found)]))
    owner, at, n_boxes = (np.concatenate(x).astype(np.int64) for x in (owners, members, sizes))
    first = np.cumsum(n_boxes) - n_boxes
    over = lambda widest, c: widest.reduceat(columns[c][at].astype(np.float64), first) if len(first) else np.zeros(0)
    if joins_text:
        said = [" ".join(texts[at[i : i + n]]) for i, n in zip(first.tolist(), n_boxes.tolist(), strict=True)]
        confidence = over(np.minimum, "confidence")
    else:
        said, confidence = [None] * len(first), [round(x, 4) for x in over(np.maximum, "confidence").tolist()]
    values = [pa.array(said, pa.string()), pa.array(confidence, pa.float64())]
    values += [pa.array(over(widest, c)) for c, widest in zip(SIDES, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True)]
    lines = pa.StructArray.from_arrays([*values, pa.array(n_boxes)], fields=list(LINE_TYPE.value_type))
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines.take(pa.array(np.argsort(owner, kind="stable"))), type=LINE_TYPE)


def _one_image(boxes: list[dict], groups_of, keys: tuple[str, ...], joins_text: bool) -> list[dict]:
    kind = pa.list_(pa.struct([("ord", pa.int64()), ("text", pa.string()), ("confidence", pa.float64()), *[(c, pa.float64()) for c in SIDES]]))
    return lines_of(pa.array([boxes], kind), groups_of, keys, joins_text).to_pylist()[0]


def joined_rows(boxes: list[dict]) -> list[dict]:
    """G1 for the boxes of one image."""
    return _one_image(boxes, chains, ("x1", "ord"), True)


def merged_rows(boxes: list[dict]) -> list[dict]:
    """G2 for the boxes of one image."""
    return _one_image(boxes, fragments, ("y1", "x1", "ord"), False)


def _per_image(boxes: DataFrame, groups_of, keys: tuple[str, ...], joins_text: bool) -> DataFrame:
    """The kernel on each image's list of boxes. Lists travel in Arrow batches of many images, for one photograph has few boxes."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(LINE_ITEM)
    def lines(lists: pa.Array) -> pa.Array:
        return lines_of(lists, groups_of, keys, joins_text)

    typed = [F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in ("confidence", *SIDES)]]
    packed = boxes.where("x1 is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*typed))).alias("b"))
    return packed.select("image_id", F.posexplode(lines(F.col("b"))).alias("line_no", "l")).select("image_id", F.col("line_no").cast("long").alias("line_no"), "l.*")


def join_split(boxes: DataFrame) -> DataFrame:
    """G1: chains of two to four boxes on one line. boxes: image_id, ord, text, confidence, x1, y1, x2, y2."""
    return _per_image(boxes, chains, ("x1", "ord"), True)


def merge_fragments(boxes: DataFrame) -> DataFrame:
    """All boxes as lines, the same way."""
    return _per_image(boxes, fragments, ("y1", "x1", "ord"), False)


def region_order(regions: DataFrame, first: str = "serial_text") -> DataFrame:
    """``region_ord`` of each image's regions: those of the ``first`` label, then by falling confidence. regions: image_id, region_id, label, confidence."""
    order = Window.partitionBy("image_id").orderBy(F.col("label") != first, F.desc("confidence"), "region_id")
    return regions.withColumn("region_ord", F.row_number().over(order))


def best_variant(lines: DataFrame) -> DataFrame:
    """A4: per region the variant whose best line is surest, the earlier of equals. lines: image_id, region_id, variant_ord, confidence."""
    best = F.max(F.struct(F.col("confidence").alias("confidence"), (-F.col("variant_ord")).alias("back"))).alias("m")
    return lines.groupBy("image_id", "region_id").agg(best).select("image_id", "region_id", (-F.col("m.back")).alias("variant_ord"), F.col("m.confidence").alias("confidence"))


def normalised(width: float, height: float) -> list[Column]:
    """Centre and size as shares of the frame, the box clamped to it first."""
    x1, y1 = F.greatest(F.col("x1"), F.lit(0.0)), F.greatest(F.col("y1"), F.lit(0.0))
    x2, y2 = F.least(F.col("x2"), F.lit(width)), F.least(F.col("y2"), F.lit(height))
    return [((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h")]


def denormalised(width: float, height: float, margin: float = 0.0) -> list[Column]:
    """G3, the way back: whole pixels of a box cx, cy, w, h, grown by a share of its size on every side and clamped to the frame."""
    half_w, half_h = F.col("w") * (0.5 + margin), F.col("h") * (0.5 + margin)
    pixels = lambda share, whole: F.least(F.greatest(F.round(share * whole, 6).cast("long"), F.lit(0)), F.lit(int(whole)))
    return [
        pixels(F.col("cx") - half_w, width).alias("x1"), pixels(F.col("cy") - half_h, height).alias("y1"),
        pixels(F.col("cx") + half_w, width).alias("x2"), pixels(F.col("cy") + half_h, height).alias("y2"),
    ]


def expanded(width: float, height: float) -> list[Column]:
    """The serial's box grown to the stamped block."""
    line, span = F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)), F.col("x2") - F.col("x1")
    return [
        F.greatest(F.lit(0.0), F.col("x1") - span * PAD_SIDE).alias("ex1"),
        F.greatest(F.lit(0.0), F.col("y1") - line * PAD_ABOVE).alias("ey1"),
        F.least(F.lit(width), F.col("x2") + span * PAD_SIDE).alias("ex2"),
        F.least(F.lit(height), F.col("y2") + line * PAD_BELOW).alias("ey2")
    ]


def crop(width: float, height: float, pad: float = CROP_PAD, bottom: float = CROP_BOTTOM) -> list[Column]:
    """Whole-pixel window around a box, more below than elsewhere; ``is_empty`` if nothing is left."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x1, y1 = F.greatest(F.lit(0), F.floor(F.col("x1") - w * pad)), F.greatest(F.lit(0), F.floor(F.col("y1") - h * pad))
    x2, y2 = F.least(F.lit(int(width)), F.floor(F.col("x2") + w * pad)), F.least(F.lit(int(height)), F.floor(F.col("y2") + h * bottom))
    return [x1.cast("long").alias("cx1"), y1.cast("long").alias("cy1"), x2.cast("long").alias("cx2"), y2.cast("long").alias("cy2"), ((x2 <= x1) | (y2 <= y1)).alias("is_empty")]


def reprojected(scale_x: Column, scale_y: Column, offset_x: Column, offset_y: Column) -> list[Column]:
    """G6."""
    return [(F.col(c) * (scale_x if c[0] == "x" else scale_y) + (offset_x if c[0] == "x" else offset_y)).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")]


def locate_expected(lines: DataFrame, truth: DataFrame, height: float) -> DataFrame:
    """Per image the reading that best shows the expected serial. lines: image_id, ord, text, confidence, box; truth: image_id, truth_serial."""
    rows = lines.join(truth, "image_id").withColumn("c", S.serial_charset(F.col("text"))).withColumn("e", S.serial_charset(F.col("truth_serial")))
    high = F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    n = F.length("e")
    part = (F.length("c") >= 5) & F.col("e").contains(F.col("c"))
    fits = (F.col("confidence") >= 0.5) & ((F.col("x2") - F.col("x1")) / high >= 1.5) & ((F.col("y1") + F.col("y2")) / 2 / height <= 0.6) & (F.col("c") != "")
    fits = fits & ((F.length("c") >= F.greatest(F.lit(4), F.floor(n * 0.7))) | part)
    rows = rows.where(fits).withColumn("d", S.weighted_edit_distance(F.col("e"), F.col("c")))
    d = F.when(F.col("c").contains(F.col("e")) | part, F.least(F.col("d"), F.lit(0.5))).otherwise(F.col("d"))
    rows = rows.withColumn("distance", d).where(F.col("distance") < F.least(F.lit(3.0), F.greatest(F.lit(1.0), n * 0.25)))
    best = F.min(F.struct("distance", "ord", "text", "confidence", "x1", "y1", "x2", "y2")).alias("m")
    return rows.groupBy("image_id").agg(best).select("image_id", "m.*")


def iou() -> Column:
    """Intersection over union of boxes p_* and t_*."""
    w = F.greatest(F.least("p_x2", "t_x2") - F.greatest("p_x1", "t_x1"), F.lit(0.0))
    h = F.greatest(F.least("p_y2", "t_y2") - F.greatest("p_y1", "t_y1"), F.lit(0.0))
    area = lambda s: (F.col(f"{s}_x2") - F.col(f"{s}_x1")) * (F.col(f"{s}_y2") - F.col(f"{s}_y1"))
    return w * h / F.greatest(area("p") + area("t") - w * h, F.lit(1e-9))


def match_boxes(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Each prediction with the truth box of its image and class that it covers best; a truth box counts for its most confident prediction. ``is_hit`` from ``least`` on.

    Images are spread over as many tasks as keep ROWS_IN_TASK predictions each, so that what a task sorts doesn't grow with the tables."""
    spark = pred.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pred.count() / ROWS_IN_TASK))
    p = pred.select("image_id", "class_id", F.col("box_ord").alias("p_ord"), "confidence", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    t = truth.select("image_id", "class_id", F.col("box_ord").alias("t_ord"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    p, t = (side.repartition(tasks, "image_id", "class_id") for side in (p, t))
    both = p.join(t, ["image_id", "class_id"], "left").withColumn("iou", F.coalesce(iou(), F.lit(0.0)))
    best = both.groupBy("image_id", "class_id", "p_ord", "confidence").agg(F.max(F.struct("iou", -F.col("t_ord"))).alias("m"))
    best = best.select("image_id", "class_id", "p_ord", "confidence", F.col("m.iou").alias("iou"), (-F.col("m.col2")).alias("t_ord"))
    w = Window.partitionBy("image_id", "class_id", "t_ord").orderBy(F.desc("confidence"), F.desc("iou"), "p_ord")
    return best.withColumn("is_hit", (F.col("iou") >= least) & (F.row_number().over(w) == 1))


THRESHOLDS = tuple(k / 100 for k in range(50, 100, 5))


def average_precision(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class precision, recall and average precision at IoU 0.5, and the mean average precision over IoU 0.50 to 0.95.

    The area under the precision envelope, exact: every confidence is a step of the curve. At each IoU a truth box counts for its surest prediction:
    one hits from the largest IoU of the surer ones, exclusive, up to its own. So a row counts for all ten levels at once, and only counts are repeated by level. Running sums and maxima go in two levels, over thousandths of confidence and inside each of them, so no class meets in one task.
    """
    surer = Window.partitionBy("image_id", "class_id", "t_ord").orderBy(F.desc("confidence"), F.desc("iou"), "p_ord").rowsBetween(Window.unboundedPreceding, -1)
    ranked = matched.select("class_id", "confidence", "iou", F.max("iou").over(surer).alias("taken"))
    hit = lambda level: ((F.col("iou") >= level) & F.coalesce(F.col("taken") < level, F.lit(True))).cast("long")
    counted = ranked.groupBy("class_id", "confidence").agg(F.count("*").alias("n"), *[F.sum(hit(level)).alias(f"tp{k}") for k, level in enumerate(THRESHOLDS)])
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"tp{k}").alias("tp")) for k, level in enumerate(THRESHOLDS)])
    steps = counted.select("class_id", "confidence", "n", F.inline(levels)).withColumn("cell", F.floor(F.col("confidence") * 1000))
    key = ["class_id", "level", "cell"]
    down = Window.partitionBy("class_id", "level").orderBy(F.desc("cell"))
    above = lambda c: F.coalesce(F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = steps.groupBy(*key).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")).select(*key, above("tp").alias("tp_above"), above("n").alias("n_above"))
    inside = Window.partitionBy(*key).orderBy(F.desc("confidence"))
    total = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    curve = steps.join(cells, key).join(total, "class_id")
    curve = curve.withColumn("precision", (F.col("tp_above") + F.sum("tp").over(inside)) / (F.col("n_above") + F.sum("n").over(inside)))
    later = F.max("top").over(down.rowsBetween(1, Window.unboundedFollowing))
    tops = curve.groupBy(*key).agg(F.max("precision").alias("top")).select(*key, later.alias("later"))
    envelope = F.greatest(F.max("precision").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.coalesce("later", F.lit(0.0)))
    areas = curve.join(tops, key).withColumn("area", F.col("tp") / F.col("n_truth") * envelope)
    per_level = areas.groupBy("class_id", "level").agg(F.sum("area").alias("ap"), (F.sum("tp") / F.sum("n")).alias("precision"), (F.sum("tp") / F.max("n_truth")).alias("recall"))
    at_half = lambda c: F.round(F.max(F.when(F.col("level") == 0.5, F.col(c))), 4)
    return per_level.groupBy("class_id").agg(
        at_half("precision").alias("precision"), at_half("recall").alias("recall"), at_half("ap").alias("ap"),
        F.round(F.avg("ap"), 4).alias("ap_50_95")
    )
