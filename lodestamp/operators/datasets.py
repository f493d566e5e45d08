"""Dataset jobs: audit, splits without leakage, weak labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestamp.sources.lineage import materialize

SPLITS = ("train", "val", "test")
# The audit's limits.
MIN_GROUPS, MIN_PER_GROUP, MIN_TOTAL, MIN_CONDITIONS = 10, 5, 300, 3
BLUR, CONTRAST, DARK, BRIGHT = 60.0, 18.0, 25.0, 235.0


def duplicates(assets: DataFrame) -> DataFrame:
    """A5: equal contents: digest, how many, the first asset."""
    return assets.groupBy("digest").agg(F.count("*").alias("n"), F.min("asset").alias("first_asset")).where("n > 1")


def low_quality(assets: DataFrame) -> DataFrame:
    """P4."""
    return assets.where((F.col("blur") < BLUR) | (F.col("contrast") < CONTRAST) | (F.col("brightness") < DARK) | (F.col("brightness") > BRIGHT))


def counts(assets: DataFrame) -> DataFrame:
    """Rows per group and per condition."""
    per = lambda kind, c: assets.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return per("group", "grp").unionByName(per("condition", "condition"))


def resolutions(assets: DataFrame, most: int = 10) -> DataFrame:
    """The commonest resolutions (width by height, text), the smaller name first among equals."""
    name = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return assets.groupBy(name.alias("resolution")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "resolution").limit(most)


BARS = 1000


def at_positions(df: DataFrame, c: str, positions: dict[str, Column]) -> DataFrame:
    """One row: ``n``, the number of values of ``c``, and under each name the value at a position of the sorted ones (an expression of n, from 0).

    Exact, without a sort: different values are counted once, and their counts summed in at most BARS + 1 bars between the smallest and the largest of those in play, which come to the driver.
    The bar that holds the position is cut into bars again, from its own smallest to its largest value, until it has a single one. However far some values lie
    off, a round leaves a thousandth of the width, or less where values stop earlier.
    """
    values = df.where(F.col(c).isNotNull()).select(F.col(c).alias("v"))
    hist = materialize(values.groupBy("v").agg(F.count("*").alias("k")))
    whole = hist.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = whole.select("n", "lo", "hi", *[at.cast("long").alias(f"at_{name}") for name, at in positions.items()]).first()
    bars_of: dict[tuple, list] = {}

    def bars(lo, hi) -> list:
        if (lo, hi) not in bars_of:
            half = lambda x: F.lit(x).cast("double") / 2
            bar = F.floor((F.col("v").cast("double") / 2 - half(lo)) / (half(hi) - half(lo)) * BARS)
            inside = hist.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
            found = inside.groupBy(bar.alias("bar")).agg(F.sum("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            bars_of[lo, hi] = sorted(found, key=lambda r: r["lo"])
        return bars_of[lo, hi]

    out = [total["n"]]
    for name in positions:
        lo, hi, rest = total["lo"], total["hi"], total[f"at_{name}"]
        while total["n"] and lo != hi:
            for r in bars(lo, hi):
                if rest < r["k"]:
                    lo, hi = r["lo"], r["hi"]
                    break
                rest -= r["k"]
        out.append(lo)
    schema = StructType([StructField("n", LongType()), *[StructField(name, values.schema["v"].dataType) for name in positions]])
    return df.sparkSession.createDataFrame([tuple(out)], schema)


def median_of(df: DataFrame, c: str, name: str) -> DataFrame:
    """One row with the exact median of a column, the mean of the middle two of an even number."""
    rows = at_positions(df, c, {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    return rows.select(((F.col("low") + F.col("high")) / 2).alias(name))


def quality_summary(assets: DataFrame) -> DataFrame:
    """Median sharpness, mean brightness and contrast, median megapixels."""
    means = assets.agg(F.round(F.avg("brightness"), 2).alias("mean_brightness"), F.round(F.avg("contrast"), 2).alias("mean_contrast"))
    one = median_of(assets, "blur", "blur").crossJoin(median_of(assets, "width", "width")).crossJoin(means)
    return one.select(F.round("blur", 2).alias("median_blur"), "mean_brightness", "mean_contrast", F.round(F.col("width") / 1e6, 6).alias("median_mp"))


def readiness(assets: DataFrame, listed: DataFrame | None = None, corrupt: DataFrame | None = None) -> DataFrame:
    """One row with blockers and warnings (codes by comma) and ready. listed: ``grp`` of all groups; corrupt: rows of files that can't be read."""
    groups = assets.groupBy("grp").agg(F.count("*").alias("n"))
    groups = groups.agg(F.count("*").alias("n_groups"), F.sum((F.col("n") < MIN_PER_GROUP).cast("long")).alias("scarce"))
    total = assets.agg(F.count("*").alias("n"), F.countDistinct("condition").alias("n_conditions"))
    number = lambda df, name: df.agg(F.count("*").alias(name))
    none = assets.limit(0)
    one = total.crossJoin(groups).crossJoin(number(duplicates(assets), "n_dups")).crossJoin(number(low_quality(assets), "n_low"))
    one = one.crossJoin(number(none if listed is None else empty_groups(listed, assets), "n_empty")).crossJoin(number(none if corrupt is None else corrupt, "n_corrupt"))
    code = lambda when, name: F.when(when, F.lit(name))
    few = lambda c, least: (F.col(c) > 0) & (F.col(c) < least)
    some = lambda c: F.col(c) > 0
    blockers = F.array_compact(F.array(code(F.col("n") == 0, "no_assets"), code(few("n_groups", MIN_GROUPS), "few_groups")))
    warnings = F.array_compact(F.array(
        code(few("n", MIN_TOTAL), "few_assets"), code(some("scarce"), "scarce_groups"), code(some("n_empty"), "empty_groups"), code(some("n_dups"), "duplicates"),
        code(some("n_corrupt"), "corrupt"), code(some("n_low"), "low_quality"), code(few("n_conditions", MIN_CONDITIONS), "few_conditions"),
    ))
    share = F.round(F.col("n_low") / F.greatest("n", F.lit(1)), 4)
    return one.select(
        "n", "n_groups", "n_dups", "n_low", "n_empty", "n_corrupt", share.alias("low_share"), F.array_join(blockers, ",").alias("blockers"),
        F.array_join(warnings, ",").alias("warnings"), (F.size(blockers) == 0).alias("ready")
    )


def empty_groups(listed: DataFrame, assets: DataFrame) -> DataFrame:
    """Listed groups without an asset."""
    return listed.select("grp").distinct().join(assets.select("grp").distinct(), "grp", "left_anti")


def split_quotas(histogram: list[tuple[int, int]], ratios: tuple[float, float, float]) -> list[tuple[int, int, str]]:
    """(size, last rank within the size, split) of the deficit rule: largest groups first, each to the split that is relatively furthest below its target, ties in the order of the splits.

    One run at most per size and split: groups of a size are alike, so only each split's number of them matters. It is found without a step per group.
    """
    if abs(sum(ratios) - 1) > 1e-6 or sum(n for _, n in histogram) < 3:
        raise ValueError("ratios must add up to 1 and there must be three groups at least")
    whole = sum(size * n for size, n in histogram)
    target, have, out = [r * whole for r in ratios], [0, 0, 0], []
    for size, n in sorted(histogram, reverse=True):
        last = 0
        for k, took in enumerate(deficit_counts(size, n, target, have)):
            have[k] += size * took
            last += took
            if took:
                out.append((size, last, SPLITS[k]))
    return out


def deficit_counts(size: int, n: int, target: list[float], have: list[int]) -> list[int]:
    """How many of ``n`` groups of one size go to each split. A split's lack falls with every group it takes, so the rule takes the ``n`` first of three falling sequences merged."""
    lack = lambda k, j: (target[k] - (have[k] + j * size)) / max(target[k], 1e-9)
    live = [k for k in range(len(target)) if target[k] > 0]
    counts = [0] * len(target)
    if size == 0 or len(live) < 2:
        counts[max(live, key=lambda k: lack(k, 0)) if live else 0] = n
        return counts

    def first(low: int, high: int, holds) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if holds(mid) else (mid + 1, high)
        return low

    def before(k: int, j: int, other: int) -> int:
        """Groups that ``other`` takes before ``k`` takes its group ``j``: at a greater lack, or at the same one if it comes first. Division gives their number to within rounding."""
        x = lack(k, j)
        after = lambda i: lack(other, i) < x or (lack(other, i) == x and other > k)
        near = min(max(int((target[other] * (1 - x) - have[other]) / size), 0), n)
        low, high = max(near - 2, 0), min(near + 3, n)
        return first(low if not low or not after(low - 1) else 0, high if high == n or after(high) else n, after)

    for k in live:
        counts[k] = first(0, n, lambda j: j + sum(before(k, j, o) for o in live if o != k) >= n)  # noqa: B023
    return counts


CELL_GROUPS = 50_000


def seeded(c: Column, seed: object) -> Column:
    """A hash that every engine has, as hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def head_of(digest: Column) -> Column:
    """The first 32 bits of a digest as a number: it grows with the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def balanced_split(groups: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Groups (group_id, n_items) to splits. Only the histogram of sizes comes to the driver, and one row per size goes back; groups of equal size are dealt in the order of a seeded hash.

    A group's rank in its size is its rank in a cell of hashes plus the groups of earlier cells, so no task sorts a whole size.
    """
    sizes = [(r["n_items"], r["n"]) for r in groups.groupBy("n_items").agg(F.count("*").alias("n")).collect()]
    ends: dict[int, list] = {}
    for size, last, split in split_quotas(sizes, ratios):
        at = ends.setdefault(size, [0] * len(SPLITS))
        at[SPLITS.index(split) :] = [last] * (len(SPLITS) - SPLITS.index(split))
    places = groups.sparkSession.createDataFrame([(size, *at[:-1]) for size, at in ends.items()], "n_items long, train_end long, val_end long")
    cells = -(-max(n for _, n in sizes) // CELL_GROUPS)
    hashed = groups.withColumn("__h", seeded(F.col("group_id"), seed)).withColumn("__cell", F.floor(head_of(F.col("__h")) * cells / 2**32))
    earlier = Window.partitionBy("n_items").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = hashed.groupBy("n_items", "__cell").agg(F.count("*").alias("n")).select("n_items", "__cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    order = Window.partitionBy("n_items", "__cell").orderBy("__h", "group_id")
    ranked = hashed.withColumn("__in_cell", F.row_number().over(order)).join(before, ["n_items", "__cell"]).withColumn("__rank", F.col("__before") + F.col("__in_cell"))
    split = F.when(F.col("__rank") <= F.col("train_end"), SPLITS[0]).when(F.col("__rank") <= F.col("val_end"), SPLITS[1]).otherwise(SPLITS[2])
    return ranked.join(F.broadcast(places), "n_items").select("group_id", "n_items", split.alias("split"))


def top_up(assigned: DataFrame, least: int) -> DataFrame:
    """Whole labelled groups move from train to val, fewest labels first, until val has ``least`` labels. assigned: group_id, n_labelled, split.

    Each group that moves brings a label at least, so no more than ``least`` groups can move: only the first so many are ranked.
    """
    have = assigned.agg(F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n_labelled"))), F.lit(0)).alias("have"))
    first = assigned.where("split = 'train' and n_labelled > 0").orderBy("n_labelled", "group_id").limit(least)
    before = F.coalesce(F.sum("n_labelled").over(Window.orderBy("n_labelled", "group_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = first.withColumn("before", before).crossJoin(have).where(F.col("have") + F.col("before") < least).select("group_id", F.lit(True).alias("moves"))
    moved = F.coalesce("moves", F.lit(False)) & (F.col("split") == "train")
    return assigned.join(moves, "group_id", "left").select("group_id", "n_labelled", F.when(moved, "val").otherwise(F.col("split")).alias("split"), moved.alias("moved"))


def manifest(assigned: DataFrame) -> DataFrame:
    """Groups and items per split."""
    return assigned.groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("n_items").alias("n_items"))


def leaks(assigned: DataFrame) -> DataFrame:
    """Groups in more than one split."""
    return assigned.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1")


def weak_coverage(located: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of images with a located serial, in all (condition null) and per condition."""
    hit = truth.join(located.select("image_id").distinct().withColumn("hit", F.lit(1)), "image_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return hit.groupingSets([[], [F.col("condition")]], F.col("condition")).agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"), F.round(F.avg("hit"), 4).alias("coverage"))


def unlabelled(listing: DataFrame, labels: DataFrame, train: DataFrame) -> DataFrame:
    """Listed images of training groups that have no label yet."""
    return listing.join(train.select("group_id").distinct(), "group_id", "left_semi").join(labels.select("image_id").distinct(), "image_id", "left_anti")


def crops(labels: DataFrame, boxes: DataFrame, truth: DataFrame, present: DataFrame, splits: DataFrame, least_w: float = 48.0, least_h: float = 12.0, seed: int = 42) -> DataFrame:
    """Why each labelled image is or isn't a training crop (``reason``), with its split, truth and size.

    labels: image_id, group_id; boxes: image_id, box_ord, x1, y1, x2, y2, of which an image's first counts; truth: image_id, truth_serial; present: image_id of
    assets that are there; splits: group_id, split. A group without a split is dealt as a whole, two thirds of them to train.
    """
    size = F.struct("box_ord", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    box = boxes.groupBy("image_id").agg(F.min(size).alias("b"))
    there = present.select("image_id").distinct().withColumn("there", F.lit(True))
    said = truth.where("truth_serial <> ''").select("image_id", "truth_serial")
    rows = labels.join(said, "image_id", "left").join(box, "image_id", "left").join(there, "image_id", "left").join(splits.select("group_id", "split"), "group_id", "left")
    small = (F.col("b.w") < least_w) | (F.col("b.h") < least_h)
    reason = F.when(
        F.col("truth_serial").isNull(), "no_truth"
    ).when(F.col("b").isNull(), "no_box").when(F.col("there").isNull(), "missing_asset").when(small, "too_small").otherwise("used")
    dealt = F.when(head_of(seeded(F.col("group_id"), f"crop{seed}")) % 3 < 2, "train").otherwise("val")
    return rows.select("image_id", "group_id", reason.alias("reason"), F.coalesce("split", dealt).alias("split"), "truth_serial", F.col("b.w").alias("w"), F.col("b.h").alias("h"))


def crop_funnel(found: DataFrame) -> DataFrame:
    """Crops per reason and split."""
    return found.groupBy("reason", "split").agg(F.count("*").alias("n"))


def crop_summary(found: DataFrame) -> DataFrame:
    """One row on the used crops: how many, their median width and height, and the alphabet of their serials."""
    used = found.where("reason = 'used'")
    chars = used.select(F.explode(F.split("truth_serial", "")).alias("ch")).where("ch <> ''").distinct().agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("alphabet"))
    return used.agg(F.count("*").alias("n")).crossJoin(median_of(used, "w", "median_w")).crossJoin(median_of(used, "h", "median_h")).crossJoin(chars)


def pseudo_labels(pred: DataFrame, least: float = 0.70, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Accepted predictions per class and condition."""
    return pred.where((F.col("confidence") >= least) & F.col("class_id").isin(*classes)).groupBy("class_id", "condition").agg(F.count("*").alias("n"))


def assembled(items: DataFrame, labels: DataFrame, least_train: int = 100) -> DataFrame:
    """Labelled and unlabelled items per split and a verdict. items: image_id, split; labels: image_id."""
    marked = items.join(labels.select("image_id").distinct().withColumn("has", F.lit(1)), "image_id", "left")
    rows = marked.groupBy("split").agg(F.sum(F.coalesce("has", F.lit(0))).alias("n_labelled"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("n_unlabelled"))
    verdict = F.when(F.col("n_labelled") == 0, "not_trainable").when((F.col("split") == "train") & (F.col("n_labelled") < least_train), "few_labels").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def work_list(images: DataFrame, offset: int, limit: int, condition: str | None = None) -> DataFrame:
    """A slice of the sorted work, of one condition if that is asked for."""
    chosen = images if condition is None else images.where(F.col("condition") == condition)
    return chosen.orderBy("image_id").offset(offset).limit(limit)
