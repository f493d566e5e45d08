"""Inventory operators: entries, the identifiers' pattern, merging, what can be inserted, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestamp.functions import serial as S


def entries(inventory: DataFrame, attributes: tuple[str, ...] = ("brand", "size", "price")) -> DataFrame:
    """A1: one row per normalised identifier with the first record's attributes, all assets in order, and the flags P7.

    ``attributes`` names columns; one of them may be a VARIANT that holds whatever the record has.
    """
    rows = inventory.withColumn("serial", S.serial_charset(F.col("serial"))).where("serial <> ''")
    grouped = rows.groupBy("serial").agg(
        F.min("ord").alias("ord"), *[F.min_by(a, "ord").alias(a) for a in attributes if a in inventory.columns],
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "asset_id"))), lambda x: x["asset_id"]).alias("assets")
    )
    return grouped.select("*", (F.size("assets") > 1).alias("is_duplicated"), (F.length("serial") < S.MIN_RELIABLE).alias("is_too_short"))


def attributes(found: DataFrame, column: str = "attributes") -> DataFrame:
    """A1: (serial, name, value) of every attribute that an entry's record has, whichever these are. found: serial and a VARIANT of an object."""
    named = found.select("serial", F.col(column).alias("__v"))
    return found.sparkSession.sql("SELECT serial, key AS name, CAST(value AS STRING) AS value FROM {e}, LATERAL variant_explode(__v)", e=named)


def pattern(inventory: DataFrame) -> DataFrame:
    """K5: one row (min_length, max_length, mask); a mask only if all lengths agree over enough samples. 5 to 14 without any identifier."""
    serials = inventory.select(S.serial_charset(F.col("serial")).alias("s")).where("s <> ''")
    sizes = serials.agg(F.min(F.length("s")).alias("lo"), F.max(F.length("s")).alias("hi"), F.count("*").alias("n"))
    chars = serials.select(F.posexplode(F.split("s", "")).alias("pos", "ch")).groupBy("pos").agg(
        F.bool_and(F.col("ch").rlike("[0-9]")).alias("digit"), F.bool_and(F.col("ch").rlike("[A-Za-z]")).alias("letter")
    )
    kinds = chars.agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("pos", F.when(F.col("digit"), "D").when(F.col("letter"), "A").otherwise("?").alias("k")))
                ),
                lambda x: x["k"]
            ),
            ""
        ).alias("kinds")
    )
    fixed = (F.col("lo") == F.col("hi")) & (F.col("n") >= S.MIN_MASK_SAMPLES)
    return sizes.crossJoin(kinds).select(
        F.coalesce("lo", F.lit(5)).alias("min_length"), F.coalesce("hi", F.lit(14)).alias("max_length"),
        F.when(fixed, F.col("kinds")).alias("mask")
    )


def merge(live: DataFrame, static: DataFrame) -> DataFrame:
    """Live rows, and static rows whose identifier is not live; ``origin`` says which."""
    return live.withColumn("origin", F.lit("live")).unionByName(static.join(live.select("serial").distinct(), "serial", "left_anti").withColumn("origin", F.lit("static")))


def insertable(inventory: DataFrame, existing: DataFrame) -> DataFrame:
    """Identifiers not present yet and not duplicated at the source."""
    w = Window.partitionBy("serial")
    return inventory.withColumn("n", F.count("*").over(w)).where("n = 1").drop("n").join(existing.select("serial").distinct(), "serial", "left_anti")


def coverage(records: DataFrame, fields: list[str]) -> DataFrame:
    """A10: share of rows that have each field."""
    one = records.agg(*[F.count(c).alias(c) for c in fields], F.count("*").alias("__n"))
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), F.col("__n").alias("total")) for c in fields])
        ).alias("x")
    ).select(
        "x.field", "x.present", "x.total", F.when(F.col("x.total") > 0, F.round(F.col("x.present") / F.col("x.total"), 4)).alias("share")
    )


def duplicated(inventory: DataFrame) -> DataFrame:
    """Identifiers with several assets."""
    return entries(inventory).where("is_duplicated").select("serial", F.size("assets").cast("long").alias("n_assets"), F.array_join("assets", ",").alias("assets"))


def undescribed(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Assets without a description. assets, inventory: asset_id."""
    return assets.select("asset_id").distinct().join(inventory.select("asset_id").distinct(), "asset_id", "left_anti")


def issue_log(records: DataFrame) -> DataFrame:
    """How many records have each issue. records: ``issues``, an array of codes.

    The outer explode keeps the optimiser from computing the issues a second time, in a filter on their number.
    """
    return records.select(F.posexplode_outer("issues").alias("at", "issue")).where("at is not null").groupBy("issue").agg(F.count("*").alias("n"))


def outside_alphabet(inventory: DataFrame, alphabet: str) -> DataFrame:
    """Characters of identifiers that a closed alphabet lacks, with how many identifiers have them."""
    chars = inventory.select("serial", F.explode(F.array_distinct(F.split("serial", ""))).alias("ch"))
    return chars.where(~F.col("ch").isin(*alphabet)).groupBy("ch").agg(F.countDistinct("serial").alias("n_serials"))


def sync_status(merged: DataFrame) -> DataFrame:
    """Distinct identifiers by origin and in all."""
    by = lambda o: F.countDistinct(F.when(F.col("origin") == o, F.col("serial")))
    return merged.agg(by("live").alias("n_live"), by("static").alias("n_static_only"), F.countDistinct("serial").alias("n_total"))
