"""Operators 11 to 13 against brute force, their laws, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestamp.llm import kmeans, lexical, ring

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, lang string, score long, rank int, term string, shard int, at long, key string"
REST = ("en", 1, 2, "t", 3, 4, "k")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best_by_hand(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asks = defaultdict(Counter)
    for item, text in set(items):
        asks[item].update(terms(text))
    out = []
    for item, bag in asks.items():
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in bag.items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def invented(n, seed, vocabulary=300, longest=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, longest)))) for i in range(n)]


ODD_DOCS = [
    (None, None), (1, ""), (2, " -- \n"), (3, "Ärger ÄRGER ärger Äa"), (3, "Ärger ÄRGER ärger Äa"), (None, "Ärger x1 X1"), (4, "x1 " * 70_000), (5, "word"), (5, "other word"),
    (-7, "Ärger ÄRGER ärger Äa"), (6, "日本語 x1\x00y"), (7, "Äa"),
]
ODD_ITEMS = [(1, "ärger ÄRGER äa x1"), (1, "x1"), (1, "x1"), (None, "word x1"), (2, None), (3, ""), (4, "unheard"), (5, "日本語 y")]


@pytest.mark.parametrize("shard_docs, items_at_once", [(32_768, 2_000), (7, 2)])
def test_search_equals_brute_force(spark, shard_docs, items_at_once):
    docs = ODD_DOCS + invented(600, 1)
    items = ODD_ITEMS + [(100 + i, t) for i, t in invented(30, 2, longest=25)]
    table = spark.createDataFrame([(*d, *REST) for d in docs], DOC).repartition(3)
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, q int, doc_id int")
    size = lexical.table_size(table)
    found = lexical.search(lexical.build_index(table, size, shard_docs=shard_docs), size[0], lexical.items_of(asked), items_at_once=items_at_once)
    assert sorted(map(tuple, found.collect()), key=str) == best_by_hand(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(*d, *REST) for d in ODD_DOCS], DOC), spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs.where("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def shard_rows(docs, item):
    """One shard with the lists of an item, as a search group gets them."""
    bags = [terms(t) for _, t in docs]
    builder = lexical.Builder(sum(map(bool, bags)), sum(map(len, bags)))
    for i, t in docs:
        builder.add(i, t)
    rows = pa.Table.from_batches(list(builder.rows(5))).to_pandas()
    rows = rows[rows["term"].isin(item) | rows["m"].notna()].copy()
    weights = [math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for n in rows["df"]]
    return rows.assign(w=weights, items=[[1]] * len(rows), times=[[1]] * len(rows))


def test_blocks_of_non_essential_lists_stay_shut():
    rng = random.Random(3)
    # A word of every other document, a rare one, and ten documents that settle the heap at once.
    docs = [(i, "rare rare rare " + "common") for i in range(10)] + [
        (i, "common " * (i % 2) + " ".join(f"v{rng.randrange(50)}" for _ in range(20)) + (" rare" if i == 9_000 else ""))
        for i in range(10, 12_000)
    ]
    best, opened, every = lexical.search_shard(shard_rows(docs, {"common", "rare"}), 10)
    assert sorted(d for _, d, _ in best) == list(range(10))
    assert opened < every / 2


def test_postings_are_read_by_block():
    rng = random.Random(4)
    docs = [(i, "a " * rng.randrange(0, 400) + "b") for i in range(3000)]
    row = next(shard_rows(docs, {"a"})[lambda r: r["term"] == "a"].itertuples())
    m = np.frombuffer(shard_rows(docs, {"a"})["m"].dropna().iloc[0], np.int64)
    p = lexical.Postings(row, m)
    asked = np.array(sorted(rng.sample(range(3000), 500)))
    block, most = p.bounds(asked)
    worth = p.at(asked, block)
    expected = [10**9 * n // (1000 * n + 8 * int(m[d])) if (n := docs[d][1].count("a")) else 0 for d in asked]
    assert worth.tolist() == expected and (worth <= most).all()


# Ring


def test_counts_are_even_and_slots_gapless(spark):
    docs = [(None, None), (None, ""), (None, "abc"), (1, "é"), (1, "é"), (-5, "x" * 300_000)] + [(7, "hot")] * 900 + [(i, f"text {i}") for i in range(100, 1900)]
    table = spark.createDataFrame([(*d, *REST) for d in docs], DOC).repartition(5)
    rows = ring.shard(table).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    held = Counter(r.shard for r in rows)
    assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in held.items())
    again = ring.shard(table.repartition(2)).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in rows)
    assert ring.shard(table.limit(0)).collect() == []


def walk_by_hand(keys, shards, vnodes, capacity):
    """Documents one by one: in the k-th step all arcs in ring order offer what they still have to the k-th different shard."""
    points = sorted((int(hashlib.md5(f"shard {s} {v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))
    arcs = defaultdict(list)
    for key in keys:
        at = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        arcs[next((i for i, (p, _) in enumerate(points) if p >= at), 0)].append((at, key))
    placed, free = {}, list(capacity)
    for step in range(shards):
        for arc in sorted(arcs):
            seen = []
            for i in range(len(points)):
                s = points[(arc + i) % len(points)][1]
                seen += [] if s in seen else [s]
            for at, key in sorted(arcs[arc]):
                if key not in placed and free[seen[step]] > 0:
                    placed[key] = seen[step]
                    free[seen[step]] -= 1
    return placed


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_full_shards_pass_documents_clockwise(spark, slack):
    ids = list(range(700))
    rows = ring.shard(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), shards=5, vnodes=9, slack=slack).collect()
    assert {str(r.doc_id): r.shard for r in rows} == walk_by_hand(map(str, ids), 5, 9, ring.capacities(700, 5, slack))


def test_few_documents_move_when_a_shard_joins(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(20_000)], "doc_id long, text string")
    place = lambda n: {r.doc_id: r.shard for r in ring.shard(docs, shards=n, slack=0.25).collect()}
    old, new = place(8), place(9)
    assert sum(old[i] != new[i] for i in old) < 0.2 * len(old)  # 1/9 must


def test_bytes_stay_within_a_document_of_the_capacity(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(1, 3000)) for i in range(5000)], "doc_id long, text string")
    held = Counter()
    for r in ring.shard(docs, by="bytes").collect():
        held[r.shard] += r.size
    share = sum(held.values()) / 8
    assert all(abs(n - share) < 0.02 * share for n in held.values())


# Centroids


def lloyd_by_hand(rows, k, rounds, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-(2**27), min(2**27, 256 * x))) for x in v]))
    start = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))[:k]
    centres = [list(v) for _, v in start]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    own = Counter()
    for d, j in at:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


def vectors(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dim))
    return [(i, (middles[i % 7] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    same = vectors(1, 9)[0][1]
    odd = [
        (None, None), (1, []), (2, [1.0] * 63), (3, [1.0] * 63 + [None]), (4, [float("nan")] + [1.0] * 63),
        (5, [float("inf")] + [0.0] * 63), (6, [1e30] * 64), (6, [-1e300] * 64), (7, [0.0] * 64), (None, [0.5] * 64)
    ]
    rows = vectors(300, 1) + odd + [(8, same)] * 150 + [(900 + i, same) for i in range(40)]
    table = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "vec_id long, embedding array<double>, chunk int, block string, cluster int").repartition(3)
    found = kmeans.clustered(*kmeans.lloyd(table, k=12, rounds=3))
    assert sorted(map(tuple, found.collect()), key=str) == lloyd_by_hand(rows, 12, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kmeans.clustered(*kmeans.lloyd(table, k=9, rounds=2)).collect()), key=str) == lloyd_by_hand(rows, 9, 2)
    assert kmeans.clustered(*kmeans.lloyd(table.limit(0))).collect() == []


def test_blocks_of_other_widths_and_joined_slices(spark, monkeypatch):
    rows = vectors(60, 3, dim=10)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(kmeans, "BROADCAST_CELLS", 0)
    found = kmeans.clustered(*kmeans.lloyd(table, k=6, rounds=2, dim=10, block_dims=4))
    assert sorted(map(tuple, found.collect()), key=str) == lloyd_by_hand(rows, 6, 2, dim=10)
