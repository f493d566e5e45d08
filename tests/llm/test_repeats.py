"""Rows that share ids, long conversations and documents of many lines."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from lodestamp.llm import chat, langid, linededup, suffixes


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_suffixes_of_ids_with_several_texts(spark):
    a, b = words(88, 1), words(60, 2)
    rows = [
        (1, " ".join(words(40, 3) + a)), (2, " ".join(a + b)), (1, " ".join(words(60, 4))), (1, ""), (3, " ".join(b + words(9, 5))),
        (3, " ".join(words(200, 6) + b)), (3, " ".join(b + words(9, 5)))
    ]
    seen = defaultdict(set)
    for i, t in rows:
        x = t.split()
        for k in range(len(x) - 49):
            seen[tuple(x[k : k + 50])].add(i)
    want = {(i, k + j) for i, t in rows for k in range(len(t.split()) - 49) if len(seen[tuple(t.split()[k : k + 50])]) > 1 for j in range(50)}
    for hot in (suffixes.HOT, 1):
        found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        assert {(r.doc_id, j) for r in found for j in range(r.first_word, r.first_word + r.n_words)} == want
        assert all(r.doc_id != r.other_doc_id for r in found)


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows))
    rows = spark.range(6000).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("fr").alias("lang"))
    for doc_id in (F.lit(7), F.lit(None), F.lit(8)):
        langid.fit(rows.withColumn("doc_id", doc_id.cast("long")), per_lang=100)
        n = defaultdict(int)
        for r in seen[-1]:
            n[r["lang"]] += 1
        assert n == {"en": 100, "fr": 100}
    langid.fit(rows.withColumn("doc_id", F.lit(1).cast("long")).withColumn("text", F.lit("the same")), per_lang=100)
    assert sorted(r["lang"] for r in seen[-1]) == ["en", "fr"]


def test_routed_lines_cost_no_more_in_long_documents(spark):
    lines = [f"line {i}" for i in range(100_000)]
    docs = spark.createDataFrame([(k, "\n".join([*lines, f"own {k}"])) for k in range(3)], "doc_id long, text string")
    began = time.time()
    out = linededup.dedup_lines(docs, min_docs=3, resident_keys=0).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert {tuple(r) for r in out} == {(k, f"own {k}", 100_001, 100_000) for k in range(3)}
    assert time.time() - began < 120


def test_loss_of_a_long_conversation_is_read_in_one_pass(spark):
    n = 100_000
    said = F.concat(F.lit("say <|im_end|> "), F.col("id").cast("string"))
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text")
    )
    out = chat.format_chat(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    began = time.time()
    loss = out.select(chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("x")).first().x
    assert loss == [f"say <|im_end|> {i}" for i in range(1, n, 2)]
    assert time.time() - began < 120
