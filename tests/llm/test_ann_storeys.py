"""The lower storey of the nearest-neighbour tree: leaves of constant size while the table grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestamp.llm import ann
from lodestamp.llm.common import materialize


def clustered(n, d=12, groups=150, seed=4):
    rng = np.random.default_rng(seed)
    centres = 6 * rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d))


def frame(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)


def storeys(spark, rows, leaf, most):
    pts = materialize(ann.points(frame(spark, rows), 5, "vec_id", "embedding"))
    tree = spark.sparkContext.broadcast(ann.Tree(ann.unit(rows[:most]), leaf))
    celled = materialize(ann.routed(pts, tree))
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    index, trees = ann.refined(celled, counts, leaf, most)
    return counts, materialize(index), trees


def test_leaves_stay_small_when_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    for n in (2_000, 8_000):
        counts, index, trees = storeys(spark, clustered(n), leaf=16, most=400)
        held = index.groupBy("cell", "leaf").count().toPandas()
        assert held["count"].sum() == n and index.select("point").distinct().count() == n
        assert held["count"].max() <= ann.REFINE * 16
        assert {r.cell for r in trees.collect()} == {c for c, size in counts.items() if size > ann.REFINE * 16}
        assert held.groupby("cell")["count"].sum().to_dict() == counts
    assert trees.count() > 1


@pytest.mark.parametrize("block_rows", [200, 5_000])
def test_recall_with_two_storeys(spark, monkeypatch, block_rows, caplog):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rows = clustered(5_000)
    with caplog.at_level("INFO", logger=ann.__name__):
        got = ann.nearest(frame(spark, rows), F.col("vec_id") % 25 == 0, leaf=16, max_sample=400, calibration=60).toPandas()
    said = [r for r in caplog.records if r.name == ann.__name__]
    assert len(said) == 1 and said[0].args[2] >= 0.95
    asked = np.arange(0, 5_000, 25)
    cosine = ann.unit(rows)[asked] @ ann.unit(rows).T
    cosine[np.arange(len(asked)), asked] = -2
    true = np.argsort(-cosine, axis=1)[:, :5]
    assert len(got) == 5 * len(asked) and set(got["query_id"]) == set(asked.tolist())
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(found[q] & set(t.tolist())) / 5 for q, t in zip(asked.tolist(), true, strict=True)]) >= 0.9
    scores = cosine[got["query_id"].to_numpy() // 25, got["vec_id"].to_numpy()]
    assert np.abs(scores - got["score"].to_numpy()).max() < 1e-12


def test_near_equal_vectors_of_a_large_cell(spark, monkeypatch):
    """A cell that no tree can cut stays one leaf, in several blocks."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rows = np.ones((700, 4)) + 1e-12 * np.arange(700)[:, None] * np.array([1, 0, 0, 0])
    rows = np.concatenate([rows, -np.eye(4)])
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, leaf=8, max_sample=300, calibration=20)
    assert [r["count"] for r in got.groupBy("query_id").count().collect()] == [5] * 8
