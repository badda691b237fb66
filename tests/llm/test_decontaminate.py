import random

import numpy as np
import pytest

from noticelake.llm import decontaminate as D


def prose(rng, n, language=0):
    parts = ["ba", "ke", "lo", "ti", "su", "ra", "mo", "ne", "vi", "da"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2, 3, 4)))) + "xyz"[language] * (rng.random() < 0.1) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, rng.choice((12, 25, 40, 60, 90, 150))))) for i in range(30)]
    docs, want = [], set()
    for d in range(400):
        words = prose(rng, rng.randint(5, 300))
        if d % 4 == 0:
            i, text = rng.choice(items)
            part = text.split()
            if d % 8 == 0:  # a paraphrase: some words of its first part differ, case and marks too
                part = [w if rng.random() < 0.85 or k > len(part) - 8 else rng.choice(prose(rng, 1)) for k, w in enumerate(part)]
                part = [w.upper() + "," if rng.random() < 0.2 else w for w in part]
            at = rng.randint(0, len(words))
            words[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(words)))
    return items, docs, want


def test_planted_items_are_found_and_clean_documents_left(spark, planted):
    items, docs, want = planted
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got & want) >= 0.95 * len(want)
    verbatim = {(d, i) for d, i in want if d % 8}
    assert verbatim <= got


def test_subsequence_by_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 80))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.subsequence(D.masks(np.array(a)), len(a), b) == table[-1][-1]


def test_a_paraphrase_needs_the_answer(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    half = [w if k % 3 else rng.choice(prose(rng, 1)) for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(prose(rng, 50) + half + ["forty", "two"])), (2, " ".join(prose(rng, 50) + half))], "doc_id long, text string")
    with_answer = spark.createDataFrame([(7, " ".join(item), "Forty-two")], "item_id long, text string, answer string")
    found = D.contaminated(docs, with_answer).collect()
    assert [(r.doc_id, r.item_id, r.paraphrase) for r in found] == [(1, 7, True)]


def test_groups_of_items(spark, planted, monkeypatch):
    items, docs, want = planted
    frames = spark.createDataFrame(docs[:100], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(*frames).collect()}
    monkeypatch.setattr(D, "GROUP_WORDS", 700)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(*frames).collect()} >= {p for p in whole if p[0] % 8}


def test_awkward_rows(spark, documents, nothing):
    passage = documents.where("doc_id = 7").first().text
    bench = spark.createDataFrame([(1, " ".join(passage.split()[:40]), 5), (1, " ".join(passage.split()[:40]), 5), (2, None, 0), (3, "", 0),
                                   (None, passage, 0), (4, "too short", 0)], "item_id long, text string, doc_id int")
    found = D.contaminated(documents, bench)
    holding = documents.where("contains(text, 'w1x827 w2x')").select("doc_id").distinct().collect()
    got = found.select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {1, 2, None, 6, 7} >= {r.doc_id for r in holding}
    kept = D.drop(documents, bench)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "8", "None"]
    assert D.contaminated(nothing, bench).count() == D.drop(nothing, bench).count() == 0
    assert D.drop(documents, bench.limit(0)).count() == documents.count()


def test_candidates_do_not_depend_on_the_rank(spark, monkeypatch):
    """Many items, few dimensions: every window that stands by brute force is found."""
    monkeypatch.setattr(D, "RANK", 2)
    rng = random.Random(21)
    vocabulary = prose(rng, 400)
    items = [[rng.choice(vocabulary) for _ in range(rng.choice((8, 12, 25, 38, 60, 90)))] for _ in range(300)]
    docs = []
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        part, keep = list(items[d]), rng.choice((1, 0.8, 0.7))
        part = [w if rng.random() < keep or k >= len(part) - D.ANSWER else rng.choice(vocabulary) for k, w in enumerate(part)]
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + part + words[at:]), part))
    want = set()
    for d, _, part in docs:
        known = {w: i for i, w in enumerate(vocabulary)}
        item = [known[w] for w in items[d]]
        if D.subsequence(D.masks(np.array(item)), len(item), [known[w] for w in part]) >= D.ALIKE * len(item):
            want.add((d, d))
    found = D.contaminated(spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string"),
                           spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert len(want) > 250 and want <= {(r.doc_id, r.item_id) for r in found}
