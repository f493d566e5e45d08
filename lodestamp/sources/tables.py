"""Sources and sinks (S1-S15). Readers keep an ordinal wherever order decides later."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestamp.functions.serial import serial_charset

# Columns of the live inventory table.
LIVE_COLUMNS = [
    "id", "numero_serie", "marca", "anio_fabricacion", "tipo_gas", "unidad_medida", "peso", "ancho_diametro", "largo_altura", "litros",
    "contenido", "color", "ph", "procedencia"
]
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def read_inventory_json(spark: SparkSession, path: str, record: str) -> DataFrame:
    """An object with ``cylinders`` or a bare list; what isn't an object is dropped, corrupt files give nothing. ``record``: DDL of the fields that
    become columns; ``attributes`` holds all that the record has, as a VARIANT."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    bare = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>"))
    inside = F.from_json("value", "cylinders array<string>")["cylinders"]
    rows = text.select("file", F.posexplode(F.coalesce(bare, inside)).alias("ord", "raw")).where(F.col("raw").startswith("{"))
    return rows.select(
        "file", F.col("ord").cast("long").alias("ord"), F.from_json("raw", record).alias("r"), F.try_parse_json("raw").alias("attributes")
    ).select("file", "ord", "r.*", "attributes")


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """(image, serial); either spelling of the headers, blanks dropped, the last row of an image wins: of the last file by name, and there of the last line."""
    raw = spark.read.csv(path, header=True)
    pick = lambda *names: F.trim(F.coalesce(*[F.col(n) for n in names if n in raw.columns]))
    rows = raw.select(
        pick("imagen", "image").alias("image"), serial_charset(pick("numero_serie", "serial")).alias("serial"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("ord")
    )
    return rows.where("image <> '' and serial <> ''").groupBy("image").agg(F.max_by("serial", "ord").alias("serial"))


def read_listing(spark: SparkSession, path: str, truth: DataFrame | None = None) -> DataFrame:
    """S3: one path a line; if there is no such file, the images of ``truth``."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if truth is None:
            raise
        return truth.select("image").distinct()
    return lines.select(F.trim("value").alias("image")).where("image <> ''")


def read_box_labels(spark: SparkSession, path: str, class_id: int | None = None) -> DataFrame:
    """Lines of exactly five tokens: class and box as shares of the frame; of each file the first line, or the first of a class."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"),
        F.split(F.trim("value"), r"\s+").alias("p")
    ).where(F.size("p") == 5)
    rows = rows.select(
        "file", "ord", F.col("p")[0].try_cast("int").alias("class_id"),
        *[F.col("p")[k + 1].try_cast("double").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))]
    )
    rows = rows.where("class_id is not null") if class_id is None else rows.where(F.col("class_id") == class_id)
    return rows.groupBy("file").agg(F.min_by(F.struct("class_id", "cx", "cy", "w", "h"), "ord").alias("b")).select("file", "b.*")


def list_assets(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, digest: bool = False) -> DataFrame:
    """Files below ``root`` with group (first folder) and condition (second). Contents are read only for a digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    parts = F.split(rel, "/")
    rows = files.select(
        rel.alias("asset"), F.when(F.size(parts) > 1, parts[0]).otherwise("(raíz)").alias("grp"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("(raíz)").alias("condition"), "length",
        *([F.sha1("content").alias("digest")] if digest else [])
    )
    return rows.where(F.lower(F.substring_index("asset", ".", -1)).isin(*suffixes))


def read_live(spark: SparkSession, url: str, table: str, upper: int, partitions: int = 16, **options) -> DataFrame:
    """The live table's columns over JDBC, in parallel ranges of its id."""
    return spark.read.jdbc(url, table, column="id", lowerBound=0, upperBound=upper, numPartitions=partitions, properties=options).select(*LIVE_COLUMNS)


def existing_keys(live: DataFrame) -> DataFrame:
    """S7."""
    return live.select(serial_charset(F.col("numero_serie")).alias("serial")).where("serial <> ''").distinct()


def write_snapshot(inventory: DataFrame, path: str, version: str) -> None:
    """A versioned snapshot; readers take the newest version."""
    inventory.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


def write_truth(assets: DataFrame, inventory: DataFrame, path: str) -> None:
    """One row per image of every described asset."""
    assets.join(
        inventory.select(F.col("asset_id").alias("grp"), F.col("serial").alias("numero_serie")), "grp"
    ).select(F.col("asset").alias("imagen"), "numero_serie").write.mode("overwrite").csv(path, header=True)


def write_split_listing(assigned: DataFrame, path: str) -> None:
    """A text listing per split. assigned: image, split."""
    assigned.select("split", F.col("image").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """One JSON object per answer, by UTC day and batch. rows: ts and any columns. A batch that is written again replaces what it wrote; without a name it is one of its own."""
    named = rows.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch or f"run-{uuid.uuid4().hex}"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)


def purge_log(spark: SparkSession, path: str, today: str, keep_days: int) -> list[str]:
    """Deletes the day partitions of the log older than the retention and names them; folders that are no dates stay."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = date.fromisoformat(today) - timedelta(days=keep_days)
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        try:
            old = name.startswith("day=") and date.fromisoformat(name.removeprefix("day=")) < oldest
        except ValueError:
            continue
        if old and files.delete(status.getPath(), True):
            gone.append(name.removeprefix("day="))
    return sorted(gone)


def write_report(metrics: DataFrame, path: str) -> None:
    """A report as long rows (report, metric, dims, value)."""
    metrics.write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Path and text, tab-separated, per split, and the alphabet beside it."""
    rows.select("split", "image", "text").write.mode("overwrite").partitionBy("split").option("sep", "\t").csv(f"{path}/lines")
    rows.select(F.explode(F.split("text", "")).alias("ch")).distinct().orderBy("ch").coalesce(1).write.mode("overwrite").text(f"{path}/alphabet")


def insert(rows: DataFrame, url: str, table: str, owner: int | None, apply: bool = False, **options) -> DataFrame:
    """What would be inserted; written only with ``apply``, which needs an owner."""
    if apply and owner is None:
        raise ValueError("an owner is needed to insert")
    out = rows.withColumn("cliente_id", F.lit(owner).cast("long"))
    if apply:
        out.write.jdbc(url, table, mode="append", properties=options)
    return out
