"""What is fitted after the log-odds (7) and the softmax's training (10), by hand."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lodestamp.llm import langid, toxicity

TEXTS = [
    ("you bad worm and bad day", 1), ("bad bad dog", 1), ("bad sky worm", 1), ("fine day", 0), ("fine sky and dog", 0), ("fine fine", 0),
    ("day and sky", 0), ("fine dog and day", 0),
    ("unheard words here", None), (None, 1), ("", 0),
] * 12 + [("fine bad day", 0)] * 2


def fitted(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(TEXTS) if x is not None], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity_prior_counts_words_of_labelled_documents(spark):
    model = fitted(spark)
    n = {k: Counter() for k in ("all", 0, 1)}
    for t, x in TEXTS:
        for w in set(toxicity.tokens(t)):
            n["all"][w] += 1
            if x is not None:
                n[x][w] += 1
    known = [w for w in n["all"] if n[0][w] + n[1][w]]
    assert b"unheard" not in known
    every, t, c = sum(n["all"][w] for w in known), sum(n[1].values()), sum(n[0].values())
    w, p = b"bad", t / (t + c)
    prior = toxicity.PRIOR * n["all"][w] / every
    odds = math.log((n[1][w] + prior) / (t + toxicity.PRIOR - n[1][w] - prior)) - math.log((n[0][w] + prior) / (c + toxicity.PRIOR - n[0][w] - prior))
    both = n[0][w] + n[1][w]
    z = math.sqrt(2 * (n[1][w] * math.log(n[1][w] / (both * p)) + n[0][w] * math.log(n[0][w] / (both * (1 - p)))))
    features = {f for w in known for f in toxicity.features(w)}
    tested = [f for f in features if sum(n[0][w] + n[1][w] for w in known if f in toxicity.features(w)) >= toxicity.LEAST_DOCS]
    bar = max(3.0, math.sqrt(2 * math.log(len(tested))))
    assert abs(model.scores[b"=bad"] - odds * (1 - (bar / z) ** 2)) < 1e-9


def test_toxicity_lambda_k_and_curve_by_hand(spark):
    model = fitted(spark)
    clean = Counter(w for t, x in TEXTS if x == 0 for w in set(toxicity.tokens(t)))
    total, shares = sum(clean.values()), defaultdict(float)
    for w, k in clean.items():
        shares[round(model.token_score(w), 2)] += k / (total + 1)
    moment = sum(p * math.exp(model.lam * s) for s, p in shares.items()) + math.exp(model.lam * (max(model.scores.values()) - toxicity.DRIFT)) / (total + 1)
    assert abs(moment - 1) < 1e-6 or model.lam == 0.05
    best = [(max((s for _, _, s in model.passages(f)), default=0.0), len(f)) for f in (toxicity.tokens(t) for t, x in TEXTS if x == 0)]
    hit = [(s, m) for s, m in best if s > 0]
    share = len(hit) / len(best)
    # As many clean documents as do so must be expected to exceed their own best scores.
    expected = len(hit) / sum(m * math.exp(-model.lam * s) for s, m in hit) * share
    assert hit and abs(model.k - max(1e-6, min(1.0, expected))) < 1e-9
    x = np.array([math.log1p(model.evidence(t)[0]) for t, y in TEXTS if y is not None])
    y = np.array([float(y) for _, y in TEXTS if y is not None])
    p = 1 / (1 + np.exp(-(model.a * x + model.b)))
    assert abs(((p - y) * x).sum() + 1e-2 * model.a) < 1e-5 and abs((p - y).sum() + 1e-2 * model.b) < 1e-5


def test_language_training_by_plain_steps(monkeypatch):
    """The same steps as train() takes, one document and one subword at a time."""
    monkeypatch.setattr(langid, "EPOCHS", 2)
    texts = {
        "en": ["the cat and the dog", "a house of the man", "and then the day", "this is that"],
        "fr": ["le chat et le chien", "une maison du matin", "et puis le jour", "ceci est cela"]
    }
    table = pa.table({"lang": [k for k in texts for _ in texts[k]] * 5, "text": [t for k in texts for t in texts[k]] * 5, "part": list(range(40))})
    rows = [r for b in langid.count_batches(iter(table.to_batches())) for r in b.to_pylist()]
    model = langid.train(rows)
    rng = np.random.default_rng(7)
    order = rng.permutation(40)
    used = order[4:]
    rows = sorted(rows, key=lambda r: (r["part"], r["lang"]))
    bags = [dict(zip(np.frombuffer(r["at"], "<u2").tolist(), np.frombuffer(r["share"], "<f4").tolist(), strict=True)) for r in rows]
    y = [("en", "fr").index(r["lang"]) for r in rows]
    weight = [len(used) / (2 * max(1, sum(y[i] == k for i in used))) for k in (0, 1)]
    emb = rng.normal(0, 1.0, (langid.BUCKETS, langid.DIM)).astype(np.float32).astype(np.float64)
    out = np.zeros((langid.DIM, 2))
    for epoch in range(2):
        rate = langid.RATE * (1 - epoch / 2)
        for at in range(0, len(used), langid.BATCH):
            ids = used[at : at + langid.BATCH] if epoch == 0 else rng.choice(used, min(langid.BATCH, len(used)), replace=False)
            moved, layer = defaultdict(lambda: np.zeros(langid.DIM)), np.zeros_like(out)
            for i in ids:
                h = sum(s * emb[b] for b, s in bags[i].items())
                z = np.exp(h @ out - (h @ out).max())
                g = z / z.sum()
                g[y[i]] -= 1
                g *= weight[y[i]] / len(ids)
                layer += np.outer(h, g)
                for b, s in bags[i].items():
                    moved[b] += s * (out @ g)
            for b, v in moved.items():
                emb[b] -= rate * 20 * v
            out -= rate * layer
    assert np.abs(model.logits - emb @ out).max() < 1e-2 * np.abs(emb @ out).max()
