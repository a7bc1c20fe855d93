"""One round of co-training against a plain version."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import cotrain
from starfold.llm.views import content_tokens, metadata_tokens, places


def corpus(seed=4, count=500):
    rng = random.Random(seed)
    good, bad = [f"fine{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(count):
        reject = rng.random() < 0.4
        own, other = (bad, good) if reject else (good, bad)
        words = rng.choices(own, k=6) + rng.choices(other, k=2) + rng.choices(["the", "of", "and"], k=4)
        source = f"s{rng.randrange(3) + (2 if reject else 0)}"
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), source, 1))
        if i < 200:
            labels.append((i, int(not reject or rng.random() < 0.05), 0))
    return rows, labels


def told(rows, labels):
    """The telling places of (places, label) pairs."""
    n, bad = len(rows), sum(labels)
    df, k = Counter(p for x in rows for p in x), Counter(p for x, y in zip(rows, labels) if y for p in x)
    rate = bad / n

    def term(seen, expected):
        return seen * math.log(seen / expected) if seen > 0 else 0.0

    def gain(p):
        d, b = df[p], k[p]
        return (
            term(b, d * rate) + term(d - b, d * (1 - rate)) + term(bad - b, (n - d) * rate)
            + term(n - d - bad + b, (n - d) * (1 - rate))
        )

    best = sorted(((-gain(p), p) for p in df if df[p] >= cotrain.LEAST_DOCS))
    return [p for i, (g, p) in enumerate(best) if i < cotrain.LEAST_TOKENS or -g >= cotrain.SURE_GAIN]


def logistic(x, y, penalty):
    """Newton steps on the mean loss plus half the penalty on the weights, none on the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-12
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(ridge), x.T @ (p - y) / len(y) + ridge * w)
        w -= step
    return w


def table_of(rows, found):
    return np.array([[float(p in x) for p in found] for x in rows])


def test_one_round_by_hand(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, marks, rounds=1)
    got = {r.doc_id: (r.content_p, r.metadata_p, r.reject_p) for r in cotrain.score(docs, model).collect()}

    views = {i: (places(content_tokens(t)), places(metadata_tokens(s, lang, t))) for i, t, lang, s, _ in rows}
    y = {i: 1 - q for i, q, _ in labels}
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(cotrain.HOLD_OUT)) == 0
    held = {r.doc_id for r in marks.where(held).collect()}
    train = [i for i in y if i not in held]
    out = sorted(held)
    pool = [i for i in views if i not in y]
    pseudo = ([], [])
    for turn in range(2):
        margins, scales = [], []
        for v in (0, 1):
            ids, labels_ = train + [i for i, _ in pseudo[v]], [y[i] for i in train] + [p for _, p in pseudo[v]]
            own = [views[i][v] for i in ids]
            found = told(own, labels_)
            w = logistic(table_of(own, found), np.array(labels_, float), cotrain.PENALTY / len(ids))
            margins.append({i: float(table_of([views[i][v]], found)[0] @ w[:-1] + w[-1]) for i in views})
            scales.append(cotrain._logistic(np.array([[margins[v][i]] for i in out]), np.array([y[i] for i in out], float)))
        if turn == 0:
            for giver, taker in ((0, 1), (1, 0)):
                p = {i: 1 / (1 + math.exp(-(margins[giver][i] * scales[giver][0] + scales[giver][1]))) for i in pool}
                pseudo[taker][:] = [(i, int(x >= cotrain.SURE)) for i, x in p.items() if not 1 - cotrain.SURE < x < cotrain.SURE]
    assert len(pseudo[0]) + len(pseudo[1]) > 20
    both = cotrain._logistic(np.array([[margins[0][i], margins[1][i]] for i in out]), np.array([y[i] for i in out], float))
    for i, found in got.items():
        one, two = margins[0][i], margins[1][i]
        logits = (one * scales[0][0] + scales[0][1], two * scales[1][0] + scales[1][1], one * both[0] + two * both[1] + both[2])
        assert found == pytest.approx([1 / (1 + math.exp(-m)) for m in logits], abs=0.03)


def test_pseudo_labels_teach_new_words(spark):
    """A word of unlabelled documents alone gets a weight, by way of the other view."""
    rows = [(i, ("fine words here" if i % 2 else "bad junk stuff") + (" novel" if i >= 60 and i % 2 == 0 else ""), "en",
             "good" if i % 2 else "evil", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert cotrain.fit(docs, labels).content.weights["novel"] > 0


def test_no_text_meets_the_labels(spark):
    """The only shuffle of documents moves hashed tokens."""
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plans = []
    original = cotrain.cut

    def watched(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return original(df, name)

    cotrain.cut = watched
    try:
        cotrain.marked(docs, labels)
    finally:
        cotrain.cut = original
    join = plans[-1].split("Join", 1)[1]
    assert join.index("MapInArrow") < join.index("text#")
