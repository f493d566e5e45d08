"""The pipeline's stages by brute force on the smallest tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestamp.llm import bpe, simhash

from .test_ops import DOC, ODD, SF, components_by_hand, lines_by_hand, simhash_by_hand


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_stages_in_turn(spark, docs):
    kept = P.rules(spark, docs, SF)
    assert kept.columns == P.COLUMNS and 0 < kept.count() <= docs.count()
    cleaned = P.lines(spark, kept, SF)
    want = lines_by_hand([(r.doc_id, r.text) for r in kept.collect()], 10)
    assert sorted((r.doc_id or -1, r.text) for r in cleaned.collect()) == sorted((i, t) for i, _, t in want)
    assert cleaned.where("n_chars <> char_length(text)").count() == 0
    alone = P.near_copies(spark, cleaned, SF)
    fps = {r.doc_id: simhash_by_hand(r.text) for r in cleaned.collect()}
    comp = components_by_hand(list(fps.values()))
    least = defaultdict(list)
    for i, f in fps.items():
        least[comp[f]].append(i)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(min(x) for x in least.values())
    mixed = P.mix(spark, alone, SF)
    assert set(rows(mixed)) <= set(rows(alone)) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    out = P.tokens(spark, mixed, SF)
    assert out.count() == mixed.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_equals_stages(spark, docs):
    step = docs
    for _, f in P.STAGES:
        step = f(spark, step, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert key(step) == key(P.run(spark, SF))


def test_stages_take_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, DOC)
    for _, f in P.STAGES:
        f(spark, odd, SF).count()
        assert f(spark, docs.limit(0), SF).count() == 0
    kept = P.near_copies(spark, odd, SF)
    assert kept.where("doc_id = 4").count() == 1 and simhash.near_duplicates(odd).count() == len(ODD)
    assert bpe.digests(odd, bpe.tokenizer_path()).where(F.col("doc_id") == 1).first().n_tokens == 0
