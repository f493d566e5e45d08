"""Small helpers that the operators of this subpackage share.

``materialize`` cuts lineage in the folder that the cluster names in ``spark.checkpoint.dir``. Only a session on one
machine (``local[...]``) that names none gets a folder of its own; elsewhere that is an error, for a machine's own folder is lost with it.

Where an operator adds a column whose name a table has already, in any case of letters, the table's column gives way. Names that begin with two
underscores are the operators' own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage: space, tab, LF, VT, FF and CR.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: no later job recomputes them or depends on a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_columns(df: DataFrame, value: Column, made) -> DataFrame:
    """``df`` and the columns (name to expression) that ``made`` reads from ``value``. Columns of ``df`` with these names give way."""
    named = made(F.col("__made"))
    kept = df.select("*", value.alias("__made")).drop(*named)
    return kept.select("*", *[c.alias(name) for name, c in named.items()]).drop("__made")


HOT_SHARE, HOT_ROWS = 10_000, 1_000


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row, or a few, for each key and in ``n`` how many of the ``total`` rows have it (``n`` isn't kept).

    Keys of more than ``total / HOT_SHARE`` rows are fewer than ``HOT_SHARE``, however large the table: they are broadcast, and their
    rows stay where they are. The others are shuffled, none of them hot. Both sides are read twice.
    """
    hot = F.col("n") > max(total // HOT_SHARE, HOT_ROWS)
    known = found.where(F.col("n").isNotNull())
    few = known.where(hot).drop("n")
    one = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(known.where(~hot).drop("n"), keys)
    return one.unionByName(rest)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))
