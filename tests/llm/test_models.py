import random
import zlib

import numpy as np
import pytest

from noticelake.llm import quality_model, toxicity


def area(scores, labels):
    """Area under the ROC curve by all pairs."""
    good, bad = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def corpus(spark, sf):
    return [spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize("module, label, folds, part, least", [(quality_model, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, sf, module, label, folds, part, least):
    docs, labels = corpus(spark, sf)
    rows = module.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == part) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert area([r.score for r in held], [r[label] for r in held]) >= least


def test_held_out_labels_are_not_read(spark, sf):
    docs, labels = corpus(spark, sf)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality_model.fit(docs, x, most=60) for x in (labels, other))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_pairs_weigh_more_than_terms():
    """Toxic only if an insult and a group meet: no sum of weights can say so."""
    rng = random.Random(3)
    rows = []
    for i in range(800):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(30)}" for _ in range(6)] + ["insult"] * insult + ["group"] * group
        rows.append((toxicity.terms(" ".join(words).encode()), int(insult and group)))
    model = toxicity.train(rows, epochs=30)
    low = [toxicity.score(t.encode(), model) for t in ("insult", "group", "w1 w2", "")]
    assert toxicity.score(b"an Insult, to a group!", model) > 0.5 > max(low)


@pytest.mark.parametrize("filling", [0, 8, 60])
def test_pairs_of_terms_that_say_nothing_alone(filling):
    """True if two words agree: each of the four is as common in both classes."""
    rng = random.Random(filling)

    def row():
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(200)}" for _ in range(filling)] + [("alpha", "beta")[a], ("gamma", "delta")[b]]
        rng.shuffle(words)
        return " ".join(words).encode(), int(a == b)

    rows, later = ([row() for _ in range(n)] for n in (1600, 400))
    model = toxicity.train([(toxicity.terms(t), y) for t, y in rows])
    assert area([toxicity.score(t, model) for t, _ in later], [y for _, y in later]) >= 0.95


def test_further_factors_need_something_to_explain():
    rng = random.Random(4)
    rows = []
    for i in range(1200):  # the label is one word's, but for noise
        y = rng.random() < 0.5
        words = [f"w{rng.randrange(100)}" for _ in range(30)] + ["bad"] * y
        rows.append((toxicity.terms(" ".join(words).encode()), int(y ^ (rng.random() < 0.05))))
    model = toxicity.train(rows)
    assert model.factors.shape[1] == toxicity.FACTORS
    assert toxicity.score(b"bad", model) > 0.8 > 0.2 > toxicity.score(b"good", model)


def test_training_by_plain_loops():
    """The same steps, term by term and pair by pair."""
    rng = random.Random(7)
    texts = [[f"t{rng.randrange(12)}" for _ in range(5)] + ["yes"] * (i % 2) for i in range(60)]
    rows = [(toxicity.terms(" ".join(t).encode()), i % 2) for i, t in enumerate(texts)]
    found = toxicity.train(rows, epochs=2)
    alone, chosen = toxicity.informative(rows)
    draw, n = np.random.default_rng(11), toxicity.FACTORS
    first = draw.normal(0, 0.02, (len(alone) + 1, n))
    w, v = {b: 0.0 for b in alone}, {b: [float(x) for x in first[j]] for j, b in enumerate(alone)}
    gw, gv, gb, bias = {b: 1e-8 for b in alone}, {b: [1e-8] * n for b in alone}, 1e-8, float(np.log(31 / 31))
    for _ in range(2):
        for i in draw.permutation(len(rows)):
            here, y = [b for b in rows[i][0] if b in w], rows[i][1]
            x = bias + sum(w[b] for b in here)
            x += sum(v[a][d] * v[b][d] for j, a in enumerate(here) for b in here[j + 1:] for d in range(n))
            e = 1 / (1 + np.exp(-x)) - y
            gb += e * e
            bias -= 0.1 * e / gb ** 0.5
            old = {b: list(v[b]) for b in here}
            for b in here:
                g = e + 1e-4 * w[b]
                gw[b] += g * g
                w[b] -= 0.1 * g / gw[b] ** 0.5
                for d in range(n):
                    g = e * sum(old[o][d] for o in here if o != b) + 1e-4 * old[b][d]
                    gv[b][d] += g * g
                    v[b][d] -= 0.1 * g / gv[b][d] ** 0.5
    assert len(alone) and set(alone) <= set(chosen) and abs(found.bias - bias) < 1e-9
    for b in alone:
        at = found.place[b]
        assert abs(found.weights[at] - w[b]) < 1e-5 and np.allclose(found.factors[at][:n], v[b], atol=1e-5)


def test_ftrl_finds_the_sign():
    rows = [(np.array([1, k]), np.array([1.0, 1.0]), 1) for k in range(10, 40)] + [(np.array([2, k]), np.array([1.0, 1.0]), 0) for k in range(10, 40)]
    model = quality_model.ftrl(rows)
    assert model.weights[1] > 0 > model.weights[2] and abs(model.weights[20]) < model.weights[1]


@pytest.mark.parametrize("module, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, documents, nothing, module, label):
    schema = f"doc_id long, {label} int, score int, y int"
    some = spark.createDataFrame([(1, 1, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (6, None, 0, 0), (None, 1, 0, 0), (99, 1, 0, 0), (3, 1, 0, 0)], schema)
    for labels in (some, some.limit(0), some.where(f"{label} = 1")):
        found = module.classify(documents, labels)
        rows = found.collect()
        assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == documents.count()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert module.classify(nothing, some).count() == 0
