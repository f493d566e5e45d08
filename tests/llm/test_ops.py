"""The corpus operators against brute force, libraries and edge cases."""

import hashlib
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestamp.llm import ann, bpe, chat, langid, linededup, mixing, quality, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d", "en", None, 7), (3, " \t\n ", "en", "s", 4),
    (4, "Same line\nother", "en", "s", 1), (4, "Same line\nother", "en", "s", 1), (5, "x" * 200_000, "en", "t", 1),
    (6, "word " * 30_000, "fr", "t", 1)
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


# Suffix-array dedup


def covered(rows, w):
    seen = defaultdict(set)
    split = [(i, t.encode().split()) for i, t in rows if i is not None and t is not None]
    for i, x in split:
        for a in range(len(x) - w + 1):
            seen[tuple(x[a : a + w])].add(i)
    return {(i, j) for i, x in split for a in range(len(x) - w + 1) if len(seen[tuple(x[a : a + w])]) > 1 for j in range(a, a + w)}


def spans(df):
    return {(r.doc_id, j) for r in df.collect() for j in range(r.first_word, r.first_word + r.n_words)}


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffixes_equal_all_windows(spark, docs, hot):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert spans(suffixes.repeated_passages(docs, hot=hot)) == covered(rows, 50)


def test_suffixes_planted_and_odd(spark, odd):
    shared = words(55, 1)
    rows = [
        (10, " ".join(words(80, 2) + shared + words(9, 3))), (11, " ".join(words(5, 4) + shared + words(70, 5))),
        (12, " ".join(words(300, 6))), (13, "the same " * 200), (14, "the same " * 30)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.repeated_passages(df)
    assert spans(found) == covered(rows, 50)
    assert {(r.doc_id, r.first_word, r.n_words, r.other_doc_id) for r in found.collect()} >= {(10, 80, 55, 11), (11, 5, 55, 10)}
    assert suffixes.repeated_passages(odd).count() == 0  # equal rows share their id
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


# Line dedup


def lines_by_hand(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = defaultdict(int)
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] += 1
    return sorted((i or -1, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not key(x) or n[key(x)] < least)) for i, t in rows)


@pytest.mark.parametrize(("resident", "least"), [(500_000, 3), (40, 3), (0, 2), (500_000, 10**6)])
def test_lines_resident_and_routed(spark, docs, odd, resident, least):
    both = docs.unionByName(odd)
    out = linededup.dedup_lines(both, min_docs=least, resident_keys=resident)
    rows = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    assert sorted((r.doc_id or -1, r.n_lines, r.kept_text) for r in out.collect()) == lines_by_hand(rows, least)


def test_lines_routed_in_bounded_groups(spark, monkeypatch):
    rows = [(i, "\n".join([f"rare {i} {j}" for j in range(40)] + [f"often {i % 7}", "always"])) for i in range(100)]
    probe = linededup.probe_routed

    def bounded(key, lines, shard, min_docs):
        assert len(lines) <= 800, f"{len(lines)} lines in one group"
        return probe(key, lines, shard, min_docs)

    monkeypatch.setattr(linededup, "ROUTED_LINES", 500, raising=False)
    monkeypatch.setattr(linededup, "probe_routed", bounded)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), resident_keys=0)
    assert sorted((r.doc_id, r.n_lines, r.kept_text) for r in out.collect()) == [(i, 42, "\n".join(f"rare {i} {j}" for j in range(40))) for i, _ in rows]


def test_lines_columns_and_empty(spark, docs):
    clash = docs.limit(3).withColumn("lines", F.lit(1)).withColumn("shard", F.lit("x"))
    assert linededup.dedup_lines(clash, min_docs=2).columns == [*clash.columns, "kept_text", "n_lines", "n_dropped"]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(linededup.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


# Chat


def test_chat_round_trip(spark):
    t = chat.DEFAULT
    nasty = ["", "\\", "<", "<|im_end|>", "\\<|im_start|>\\\\", "<|im_<|im_end|>end|>", "a\nb", "é😀", "$1 \\1", *t.controls]
    rows = [(1, i, x, y) for i, (x, y) in enumerate((a, b) for a in ["user", "assistant", "<|im_sep|>", None] for b in [*nasty, None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))
    r = out.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x.role, x.text) for x in r.turns] == [(x or "", y or "") for _, _, x, y in rows]
    assert list(r.loss) == [y or "" for _, _, x, y in rows if x == "assistant"]


def test_chat_attachments(spark):
    part = lambda **k: tuple(k.get(x) for x in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (
            7, 0, "user",
            [
                part(type="text", text="see "), part(type="image", ref="a.png", width=57, height=28),
                part(type="audio", ref="b.wav", seconds=1.5), None, part(type="document", ref="c.pdf", pages=2), part(type="video")
            ]
        ),
        (7, 1, "assistant", None), (8, None, None, [])
    ]
    out = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()}
    assert out[7].formatted == "<|im_start|>user<|im_sep|>see <|image|><|audio|><|document|><|im_end|><|im_start|>assistant<|im_sep|><|im_end|>"
    assert [(a.kind, a.ref, a.n_tokens) for a in out[7].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512)]
    assert out[8].attachments == [] and out[8].loss_spans == []


def test_chat_is_native():
    source = open(chat.__file__).read()
    assert "udf" not in source and "pandas" not in source and "Pandas" not in source


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_equals_library(spark, docs, odd, library):
    nasty = ["don't ΣΑΣ İstanbul Ⅷ ½² 中文 é <|endoftext|>x<|startoftext|>", "\x1c  a b\x85c　", "<|endoftext|>", "\x00\x01 a​b", "I'LL  WE'VE\t\n'S", "ab" * 3000, "Å ﬁ"]
    both = docs.select("text").union(odd.select("text")).union(spark.createDataFrame([(x,) for x in nasty], "text string"))
    out = bpe.decode_documents(bpe.encode_documents(both, bpe.tokenizer_path()), bpe.tokenizer_path())
    again = {r.text: (r.ids, r.n_tokens, r.decoded) for r in bpe.round_trip(both, bpe.tokenizer_path()).collect()}
    for r in out.collect():
        assert again[r.text] == (r.ids, r.n_tokens, r.decoded)
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, repr((r.text or "")[:80])
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_every_code_point(library):
    v = bpe.Vocabulary(open(bpe.tokenizer_path(), encoding="utf-8").read())
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 7 == 0 or bpe.LATER.match(chr(c)))]
    texts = [f"a{chr(c)}{chr(c)}b3" for c in points]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for text, packed, want in zip(part, v.encode(part).to_pylist(), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == want.ids, ascii(text)


def test_bpe_equals_library_on_sequences_of_marks(library):
    rng = random.Random(11)
    v = bpe.Vocabulary(open(bpe.tokenizer_path(), encoding="utf-8").read())
    later = [chr(c) for a, b in bpe.LATER_MARKS for c in range(a, b + 1)]
    marks = [chr(c) for c in range(0x300, 0x1FFFF) if unicodedata.combining(chr(c))]
    bases = [*"aeOUkİΣσ", *"\u1100\u1161\u11a8\uac00\u0915\u09c7\u09be", "\U00011935", "\U00011938", "\U00011347", "\U0001133e", "\U000114b9", "\U000114ba"]
    texts = ["".join(rng.choice(rng.choice((bases, marks, marks[:60], later))) for _ in range(rng.randint(2, 7))) for _ in range(20_000)]
    texts += [b + m + n for b in bases for m in later for n in ("\u0334", "\u0301", "\u0345")]
    for text, packed, want in zip(texts, v.encode(texts).to_pylist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, ascii(text)


def test_bpe_cuts_are_certain():
    v = bpe.Vocabulary(open(bpe.tokenizer_path(), encoding="utf-8").read())
    assert all(len(list(v.cuts(t.removesuffix(v.suffix)))) == 1 for t in v.ids if t != v.suffix)
    assert sum(len(list(v.cuts("x" + chr(0x100 + a) + "zq"))) > 1 for a in range(60)) > 0


# Nearest neighbours


def cosine_brute(rows, asked, k):
    ids = [i for i, v in rows]
    m = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i in asked:
            s = (m * np.array(v)).sum(1) / np.sqrt((m * m).sum(1) * (np.array(v, np.float64) ** 2).sum())
            out[i] = sorted((-x, j) for x, j in zip(s, ids, strict=True) if j != i)[:k]
    return out


def test_ann_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    asked = {i for i, _ in rows if i % 10 == 0}
    truth = cosine_brute(rows, asked, 5)
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, leaf=16).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert all(len(found[i]) == 5 for i in asked)
    hit = sum(len({j for _, j in truth[i]} & {j for j, _ in found[i]}) for i in asked) / (5 * len(asked))
    assert hit >= 0.9
    full = cosine_brute(rows, asked, len(rows))
    for i in asked:
        score = {j: -x for x, j in full[i]}
        assert all(abs(score[j] - s) < 1e-12 for j, s in found[i])
        assert [s for _, s in found[i]] == sorted((s for _, s in found[i]), reverse=True)


def test_ann_copies_and_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [
        (50, [3.0, 2.0, 1.0]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [nan, 1.0, 1.0]), (54, [inf, 1.0, 1.0]), (55, [1.0, None, 1.0]),
        (56, [1.0]), (None, [1.0, 2.0, 3.0]), (60, [2.0, 4.0, 6.0])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(df, F.col("vec_id").isin(0, 39, 50, 51, 52), leaf=4)
    found = {(r.query_id, r.rank): r.vec_id for r in out.collect()}
    assert [found[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]
    assert [found[39, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert {q for q, _ in found} == {0, 39, 50} and len(found) == 15
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id in (50, 0)"), F.lit(True)).count() == 2


def test_ann_repeated_ids_lose_nobody(spark):
    rows = [(1, [1.0, i / 10, 0.0]) for i in range(7)] + [(2, [1.0, 0.05, 0.1]), (3, [0.9, 0.1, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.rank) for r in ann.nearest(df, F.col("vec_id") == 1).collect()]
    assert sorted(got) == [(2, 1), (3, 2)]
    got = [(r.vec_id, r.rank) for r in ann.nearest(df.where("vec_id <> 1 or embedding[1] in (0, 0.6)").unionByName(df.where("vec_id = 3")), F.col("vec_id") == 1).collect()]
    assert sorted(got) == [(2, 1), (3, 2), (3, 3)]
    two = {(r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 2, k=3).collect()}
    by_hand = sorted((-np.dot(v, [1.0, 0.05, 0.1]) / np.linalg.norm(v) / np.linalg.norm([1.0, 0.05, 0.1]), i) for i, v in rows if i != 2)[:3]
    assert two == {(k + 1, i) for k, (_, i) in enumerate(by_hand)}


def test_ann_lengths_differ(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0, 0.0]), (3, [1.0, 2.0, 3.0, 4.0]), (4, [2.0]), (5, [1e200, 2e200]), (6, [1e-200, 0.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()}
    pad = {i: np.array(v + [0.0] * (4 - len(v))) / np.abs(v).max() for i, v in rows}
    for i in pad:
        want = sorted((-round(float(pad[i] @ pad[j] / np.linalg.norm(pad[i]) / np.linalg.norm(pad[j])), 9), j) for j in pad if j != i)[:5]
        assert [(-round(got[i, k][1], 9), got[i, k][0]) for k in range(1, 6)] == want


# Quality


def test_nearest_goes_on_until_k_are_found(spark):
    rng = np.random.default_rng(6)
    tight = [c + 1e-3 * rng.normal(size=8) for c in 9 * rng.normal(size=(12, 8)) for _ in range(100)]
    alone = list(-40 * np.eye(8)[:4] + rng.normal(size=(4, 8)))  # leaves of one vector
    same = [alone[0] + 0.01 * rng.normal(size=8) for _ in range(9)]  # rows that share the id of a query
    rows = [(i, v.tolist()) for i, v in enumerate(tight + alone)] + [(1200, v.tolist()) for v in same] + [(77, tight[77].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id is not null")
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(77, 500, 1200, 1201, 1202, 1203), leaf=16).collect():
        assert r.vec_id != r.query_id
        got.setdefault(r.query_id, []).append(r.rank)
    assert {q: sorted(x) for q, x in got.items()} == {q: [1, 2, 3, 4, 5] for q in (77, 500, 1200, 1201, 1202, 1203)}


def test_quality_base_rules(spark, odd):
    rng = random.Random(3)
    texts = [
        "", "a a a a", "# $ x|y\n# $ x|y\n\n \n", " ".join(words(60, 1) + words(4, 2) + words(3, 3) + words(4, 2))
    ] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(50)]

    def by_hand(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        rep = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)

    for t in texts:
        assert quality.base_metrics(t) == by_hand(t), t
    model = quality.QualityModel(np.zeros(quality.BUCKETS), float("-inf"))
    out = {r.doc_id: r for r in quality.rate(odd, model).collect()}
    assert out[1].n_words == 0 and out[1].base_failed and not out[1].kept and out[6].base_failed


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.rate(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p"))
    p = {r.quality: r.p for r in out.collect()}
    assert p[1] >= 0.99 and p[0] <= 0.1
    none = quality.fit(docs, labels.limit(0))
    assert quality.rate(docs, none).where("kept = base_failed").count() == 0


def test_quality_weights_equal_counts(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in docs.collect():
        if r.text:
            n = np.bincount(quality.buckets(r.text.encode()), minlength=quality.BUCKETS)
            raw, good = raw + n, good + n * (r.doc_id in trusted)
    want = np.log(good / good.sum()) - np.log(raw / raw.sum())
    assert np.allclose(quality.fit(docs, labels).weights, want)


# Toxicity


def test_segments_are_maximal():
    rng = random.Random(5)
    model = toxicity.ToxicModel({b"=bad": 2.0, b"=mild": 1.1, b"=ok": -0.2})
    for _ in range(300):
        found = [rng.choice([b"bad", b"mild", b"ok", b"ok", b"ok", b"ok"]) for _ in range(rng.randint(1, 40))]
        s = [model.token_score(t) for t in found]
        best = max((sum(s[a : b + 1]) for a in range(len(s)) for b in range(a, len(s))), default=0)
        got = model.passages(found)
        if best > 0:
            assert abs(max(x for _, _, x in got) - best) < 1e-9
        for (a, b, x), nxt in zip(got, [*got[1:], None], strict=False):
            assert abs(sum(s[a : b + 1]) - x) < 1e-9 and (nxt is None or nxt[0] > b)


def segments_by_hand(s):
    """The definition: the best segment (the shortest of equals), then the same to its left and right."""
    best = max(((sum(s[a : b + 1]), a - b, a, b) for a in range(len(s)) for b in range(a, len(s))), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return segments_by_hand(s[:a]) + [(a, b)] + [(x + b + 1, y + b + 1) for x, y in segments_by_hand(s[b + 1 :])]


def test_maximal_segments_equal_the_definition():
    rng = random.Random(8)
    for _ in range(400):
        s = [rng.uniform(-1, 1) + rng.choice([-0.5, 0.2]) for _ in range(rng.randint(0, 24))]
        got = toxicity.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == segments_by_hand(s)
        assert all(abs(x - sum(s[a : b + 1])) < 1e-9 for a, b, x in got)


def test_maximal_segments_take_linear_time():
    import time

    def took(n):
        s = np.full(n, -0.3)
        s[::11] = 2.0
        began = time.perf_counter()
        toxicity.maximal_segments(s)
        return time.perf_counter() - began

    took(10_000)
    assert took(1_100_000) < 40 * took(110_000) + 0.5


def test_toxicity_log_odds_by_hand(spark):
    texts = [
        ("you bad worm", 1), ("bad day", 1), ("bad bad dog", 1), ("bad sky", 1), ("fine day", 0), ("fine sky and dog", 0), ("fine fine", 0),
        ("fine bad", 0), ("day and sky", None), (None, 1), ("", 0)
    ] * 5
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts) if x is not None], "doc_id long, toxic int")
    n = {k: defaultdict(int) for k in ("all", 0, 1)}
    for t, x in texts:
        for w in set(toxicity.tokens(t)):
            for f in toxicity.features(w):
                n["all"][f] += 1
                if x is not None:
                    n[x][f] += 1
    whole = lambda k: sum(v for f, v in n[k].items() if f[:1] == b"=")
    t, c, every = whole(1), whole(0), whole("all")
    tested = [f for f in n["all"] if n[0][f] + n[1][f] >= toxicity.LEAST_DOCS]
    bar = max(3.0, np.sqrt(2 * np.log(len(tested))))
    want = {}
    for f in tested:
        a, b, p = n[1][f], n[0][f], t / (t + c)
        z = np.sqrt(2 * sum(k * np.log(k / ((a + b) * q)) for k, q in ((a, p), (b, 1 - p)) if k))
        prior = toxicity.PRIOR * n["all"][f] / every
        odds = np.log((a + prior) / (t + toxicity.PRIOR - a - prior)) - np.log((b + prior) / (c + toxicity.PRIOR - b - prior))
        if z > bar:
            want[f] = max(-6.0, min(6.0, odds * (1 - (bar / z) ** 2)))
    got = toxicity.fit(docs, labels).scores
    assert want and set(got) == set(want) and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, toxicity.crc_mod(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs.join(labels, "doc_id").where(toxicity.crc_mod(F.col("doc_id"), 4) == 2), model).select("toxic", "predicted", "score").toPandas()
    hit = out[out.toxic == 1].predicted.mean()
    assert hit >= 0.8 and out[out.toxic == 0].predicted.mean() <= 0.02 and out.score.between(0, 1).all()


def test_toxicity_odd(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, labels))
    assert out.count() == len(ODD) and out.where("score is null or predicted <> 0").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


# Mixing


def test_mixing_targets(spark, docs, odd):
    both = docs.unionByName(odd)
    plan = mixing.plan_mix(both)
    rows = plan.collect()
    assert len(rows) == both.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(a - b) <= 1 for a, b in by.values())
    assert abs(sum(b for _, b in by.values()) - sum(r.size for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(both.repartition(7)).collect()))
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_mixing_order(spark, docs):
    order = mixing.training_order(mixing.plan_mix(docs, whole_documents=True))
    rows = order.collect()
    position = [r.position for r in rows]
    assert position == sorted(position) and 0 <= min(position) and max(position) <= 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.words
    taken = {r.doc_id: r.taken for r in mixing.plan_mix(docs, whole_documents=True).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def test_demand_inverse(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))])
    out = spark.range(11).select((F.col("id") / 10).alias("s")).select("s", mixing.demand_inverse(F.col("s"), knots).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    area = np.cumsum(np.interp(grid, [0, 0.5, 1], [1, 3, 0])) / 200_001
    for r in out:
        assert abs(np.interp(r.t, grid, area) / area[-1] - r.s) < 1e-3


# SimHash


def simhash_by_hand(t):
    import xxhash

    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    each = sorted(set(fps))
    for i, a in enumerate(each):
        for b in each[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in each}


@pytest.mark.parametrize("shard_size", [simhash.SHARD_SIZE, 3])
def test_simhash_components(spark, docs, odd, shard_size):
    both = docs.unionByName(odd)
    rows = [(r.doc_id, simhash_by_hand(r.text)) for r in both.select("doc_id", "text").collect()]
    comp = components_by_hand([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = sorted((i or -1, f, least.get(comp[f])) for i, f in rows)
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(both, shard_size=shard_size).collect())
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_size", [simhash.SHARD_SIZE, 100])
def test_bk_trees_lose_no_link(spark, shard_size):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre.tolist():
        for _ in range(60):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    from lodestamp.llm.graph import components

    root = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(df, shard_size=shard_size)).collect()}
    want = components_by_hand(list(fps))
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in {m.get(f, f) for f in fps})
    assert groups(root) == groups(want)


def test_hot_shards_are_cut_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(4)
    low = rng.integers(0, 2**48, 3000, dtype=np.uint64)
    fps = {int(x) for x in low} | {int(x) ^ sum(1 << int(b) for b in rng.choice(48, 3, replace=False)) for x in low[:300]}
    search = simhash.search_shards

    def bounded(radius):
        def run(pdf):
            assert pdf.groupby("key").size().max() <= 200 and len(pdf) <= 1200, f"{len(pdf)} rows in one group"
            return search(radius)(pdf)

        return run

    monkeypatch.setattr(simhash, "search_shards", bounded)
    monkeypatch.setattr(simhash, "BIN_ROWS", 500, raising=False)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    from lodestamp.llm.graph import components

    root = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(df, shard_size=200)).collect()}
    each = np.array(sorted(fps), np.uint64)
    near = [(int(f), int(x)) for f in each for x in each[np.bitwise_count(each ^ f) <= 3] if x != f]
    assert near and set(root) == {a for a, _ in near} and all(root[a] == root[b] for a, b in near)


# Language ID


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.crc_mod(F.col("doc_id"), 3) == 1
    out = langid.predict(docs.where(held), langid.fit(docs, ~held)).select("lang", "lang_pred", "score", "accepted").toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.97 and out.score.between(0, 1).all()
    assert (out[out.accepted].lang == out[out.accepted].lang_pred).mean() >= 0.98


def test_language_odd(spark, odd):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "é" * 100_000)]
    model = langid.train([])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}
    out = {r.doc_id: r for r in langid.predict(df, langid.fit(odd)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred != "und" and out[5].lang_pred != "und"


def test_langid_pieces_add_up(monkeypatch):
    text = " ".join(words(300, 9))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (langid.counts(text) == whole).all()


def test_digest_forms(spark):
    from lodestamp.llm.registry import QUERIES

    r = {x.doc_id: x for x in QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert all(len(x.kept_sha256) == 64 for x in r.values())
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.encode(F.lit(""), "UTF-8"), 256).alias("h")).first().h


# Columns with clashing names, empty tables


ADDED = {
    "lines": lambda df: linededup.dedup_lines(df, min_docs=2),
    "bpe round trip": lambda df: bpe.round_trip(df, bpe.tokenizer_path()),
    "bpe": lambda df: bpe.decode_documents(bpe.encode_documents(df, bpe.tokenizer_path()), bpe.tokenizer_path()),
    "quality": lambda df: quality.rate(df, quality.QualityModel(np.zeros(quality.BUCKETS), 0.0)),
    "toxicity": lambda df: toxicity.score(df, toxicity.ToxicModel({})),
    "fingerprints": simhash.fingerprints,
    "language": lambda df: langid.predict(df, langid.train([])),
}


@pytest.mark.parametrize("name", ADDED)
def test_new_columns_replace_old_ones_of_their_name(spark, odd, name):
    run = ADDED[name]
    plain = run(odd)
    new = [c for c in plain.columns if c not in odd.columns]
    clash = odd.select("*", *[F.lit("old").alias(c.upper() if k % 2 else c) for k, c in enumerate(new)], F.lit(7).alias("lines"), F.lit(8).alias("key"))
    got = run(clash)
    assert got.columns == [*odd.columns, "lines", "key", *new]
    rows = lambda df: sorted(map(str, df.select(*odd.columns, *new).collect()))
    assert rows(got) == rows(plain)
    empty = run(clash.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_clashing_columns_of_the_other_operators(spark, odd, docs):
    extra = lambda df: df.select(
        "*",
        *[
            F.lit("old").alias(c)
            for c in (
                "fp", "root", "component_id", "size", "target", "position", "cell", "order", "n", "key", "t1", "low", "pos", "formatted",
                "no", "begun"
            )
        ]
    )
    same = lambda f, df: sorted(map(str, f(extra(df)).collect())) == sorted(map(str, f(df).collect()))
    assert same(simhash.near_duplicates, odd) and same(suffixes.repeated_passages, odd)
    assert same(lambda d: mixing.plan_mix(d), odd) and same(lambda d: mixing.training_order(mixing.plan_mix(d, whole_documents=True)).drop("position"), odd)
    chats = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None)], "conv_id long, turn long, role string, text string"
    ).withColumn("parts", chat.text_parts(F.col("text")))
    assert same(chat.format_chat, chats) and chat.format_chat(chats.limit(0)).count() == 0
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    wide = vecs.select("*", *[F.lit("old").alias(c) for c in ("point", "leaf", "ids", "vec", "key", "rank", "score", "query_id")])
    ask = lambda df: sorted(map(str, ann.nearest(df, F.col("vec_id") == 1).collect()))
    assert ask(wide) == ask(vecs)
    none = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.threshold == float("-inf") and quality.rate(docs.limit(0), none).count() == 0


def test_chat_ties_go_by_raw_text(spark):
    rows = [(1, 0, "user", "<z"), (1, 0, "user", "<|im_end|>"), (1, 0, "assistant", "\\b"), (1, 0, "assistant", "a"), (1, None, "user", None)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text"))))
    r = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(x.role, x.text) for x in r.t] == [("user", ""), ("assistant", "\\b"), ("assistant", "a"), ("user", "<z"), ("user", "<|im_end|>")]
    assert list(r.l) == ["\\b", "a"]


def test_lines_with_equal_first_hashes_have_slots_of_their_own():
    import pandas as pd

    rows = pd.DataFrame({"shard": [0] * 4, "h1": [5, 5, 9, 9], "h2": [1, 2, 3, 4], "n_docs": [10, 20, 30, 2]})
    shard = linededup.Shard(next(linededup.build_shard(rows).itertuples()))
    both = lambda c: rows[c].to_numpy(np.int64).view(np.uint64)
    assert shard.count(both("h1"), both("h2")).tolist() == [10, 20, 30, 2]
    assert shard.count(np.array([5, 7], np.uint64), np.array([3, 1], np.uint64)).tolist() == [0, 0]


def test_joins_of_hot_keys_keep_everything(spark, monkeypatch):
    from lodestamp.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2, 3, 3, 4])], "k long, i long")
    found = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 4").withColumn("v", F.col("k") * 10)
    got = sorted((r.k, r.i, r.v) for r in common.join_counted(rows, found, ["k"], 13).collect())
    assert got == [(k, i, 10 * k) for i, k in enumerate([1] * 9 + [2, 3, 3])]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestamp.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://elsewhere")
    with pytest.raises(ValueError):
        common.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_language_calibration_by_brute_force(spark, docs):
    rows = [
        r
        for b in langid.count_batches(
            iter(
                __import__("pyarrow").Table.from_pandas(
                    docs.select("lang", "text").where("lang is not null").toPandas().assign(part=lambda d: range(len(d)))
                ).to_batches()
            )
        )
        for r in b.to_pylist()
    ]
    model = langid.train(rows)
    order = np.random.default_rng(7).permutation(len(rows))
    rows = sorted(rows, key=lambda r: (r["part"], r["lang"]))
    held = [rows[i] for i in order[: len(rows) // 10]]
    z = []
    for r in held:  # the mean embedding's logits, one subword after the other
        total = np.zeros(len(model.langs))
        for b, x in zip(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["share"], "<f4"), strict=True):
            total += x * model.logits[b]
        z.append(total)
    y = [model.langs.index(r["lang"]) for r in held]
    p = lambda t: [np.exp(v / t - (v / t).max()) / np.exp(v / t - (v / t).max()).sum() for v in z]
    loss = {t: -np.mean([np.log(max(x[k], 1e-12)) for x, k in zip(p(t), y, strict=True)]) for t in np.geomspace(0.1, 10, 41)}
    assert abs(loss[min(loss, key=lambda t: abs(t - model.temperature))] - min(loss.values())) < 1e-6
    accepted = [(int(x.argmax()) == k) for x, k in zip(p(model.temperature), y, strict=True) if x.max() >= model.floor - 1e-9]
    assert accepted and np.mean(accepted) >= 0.99
    text = docs.where("lang is not null").first().text
    n = langid.counts(text)
    lang, score = model.predict(text)
    one = (n / n.sum()) @ model.logits / model.temperature
    assert lang == model.langs[int(one.argmax())] and abs(score - np.exp(one.max() - np.log(np.exp(one).sum()))) < 1e-9


def test_quality_threshold_by_brute_force():
    rng = random.Random(11)
    for _ in range(50):
        docs = [(rng.gauss(1.0 if y else -1.0, 1.0), y) for y in (rng.random() < 0.7 for _ in range(200))]
        bars = defaultdict(int)
        for x, y in docs:
            bars[int(np.floor(x * quality.GRID)), int(y)] += 1
        at = quality.pick_threshold([{"bar": b, "label": y, "n": n} for (b, y), n in bars.items()])
        total = {y: sum(int(z) == y for _, z in docs) for y in (0, 1)}
        cost = lambda edge: quality.CLEAN_WEIGHT * sum(y for x, y in docs if x < edge) / total[1] + 1 - sum(not y for x, y in docs if x < edge) / total[0]  # noqa: E731, B023
        edges = [float("-inf"), *((b + 1) / quality.GRID for b, _ in bars)]
        assert abs(cost(at) - min(map(cost, edges))) < 1e-9


def test_quality_verdicts_on_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = quality.rate(
        docs, quality.fit(docs, labels.where(~held))
    ).join(labels.where(held), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p"))
    p = {r.quality: r.p for r in out.collect()}
    assert p[1] >= 0.97 and p[0] <= 0.15


def test_quality_learns_from_every_label(spark):
    n = 41_000  # more than the 40,000 that were once the most
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7).alias("text"))
    got = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"))).weights
    assert abs(got).max() < 1e-12  # all are trusted, so trusted and raw text are the same
