"""Cutting lineage in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder. Only a session on one machine that names none gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)
