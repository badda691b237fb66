import hashlib
import random
import re

from pyspark.sql import functions as F

from noticelake.llm import substrings


def by_hand(rows, size):
    """(n_words, n_removed, kept) of each (id, text)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for at in range(len(words) - size + 1):
            if i is not None:
                key = tuple(words[at:at + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - size + 1):
            if i is not None and first[tuple(words[at:at + size])] < i:
                gone.update(range(at, at + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_texts(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randint(8, 30))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 3):] if rng.random() < 0.6 else [f"u{rng.randrange(5)}" for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice([i, i, i, 3, None]), "\n ".join(words) if rng.random() < 0.95 else None))
    return rows + rows[:3]


def test_against_brute_force(spark, monkeypatch):
    for seed, hot in ((1, 2000), (2, 1), (3, 3)):
        monkeypatch.setattr(substrings, "HOT", hot)
        rows = shared_texts(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = [tuple(r) for r in substrings.digest(docs, window=9, anchor_words=4).collect()]
        assert sorted(found, key=str) == by_hand(rows, 9)


def test_awkward_rows(documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted((tuple(r) for r in substrings.digest(documents).collect()), key=str) == by_hand(rows, 50)
    assert substrings.digest(nothing).count() == 0


def test_intervals_are_maximal(spark):
    rows = spark.createDataFrame([([0, 1, 2, 7, 20],)], "s array<int>")
    assert rows.select(substrings.merged(F.col("s"), 5).alias("x")).first().x == [[0, 12], [20, 25]]


def test_words_keep_long_runs_apart(spark):
    long = "x" * 200_000
    rows = [(1, " ".join([long + "a"] + [f"k{i}" for i in range(9)])), (2, " ".join([long + "b"] + [f"k{i}" for i in range(9)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in substrings.digest(docs, window=10, anchor_words=4).collect())
    assert found == by_hand(rows, 10) and found[1][2] == 0
