import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from noticelake.llm import trie


def remainder(c):
    return c - int(c / 100) * 100


def brute_force(rows):
    """All nodes, from dictionaries of prefixes."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - remainder(c), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, path string, chunk int, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c * rng.choice([1, 1, 7]), t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [1, 30, trie.CELLS])
@pytest.mark.parametrize("words", [["a"], ["a", "bé", None], ["some text", "b", "c", "世界", ""]])
def test_equals_brute_force_whatever_the_chunks(spark, cells, words):
    rows = conversations(len(words), 260, words, 7)
    assert got(trie.nodes(frame(spark, rows), cells)) == brute_force(rows)


def test_nulls_ties_repeats_and_strange_numbers(spark):
    rows = [(0, 1, "u", "b"), (0, None, None, None), (0, 0, "u", "a"), (0, 0, "u", "a"), (0, 0, "a", "u"), (None, 0, "u", "lost"),
            (-1, 0, "u", "<|im_end|>"), (-250, 3, None, "x"), (-200, None, "u", None), (7, None, "", ""), (7, -4, "u", "first"),
            (10**12 + 5, 0, "u", "no base"), (199, 0, "u", "q"), (110, 0, "u", "short")]
    assert got(trie.nodes(frame(spark, rows), 8)) == brute_force(rows)


def test_only_short_conversations_without_a_base_leave_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert got(trie.nodes(frame(spark, [(c, 0, "u", "gone")]))) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_a_long_conversation_and_many_copies(spark):
    rows = [(5, t, "u", f"t{t}") for t in range(700)] + [(c, t, "u", f"same {t}") for c in range(100, 900) for t in range(2)]
    assert got(trie.nodes(frame(spark, rows), 2000)) == brute_force(rows)


def test_no_conversations(spark):
    assert got(trie.nodes(frame(spark, []))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=4), min_size=1, max_size=12))
def test_matrix_counts_members_of_every_prefix(paths):
    ids = np.array([bytes([0, k]) + b"\0" * 14 for p in paths for k in p], "V16")
    sizes = np.array([len(p) for p in paths])
    levels, order, *_ = trie.trie(np.arange(len(paths)), sizes, ids, np.ones(len(ids), np.int32))
    for depth, level in enumerate(levels):
        prefixes = [tuple(p[:depth]) for p in paths if len(p) >= depth]
        found = sorted(set(prefixes))
        assert level["n"].tolist() == [prefixes.count(p) for p in found]
        assert level["ends"].tolist() == [sum(tuple(q) == p for q in paths) for p in found]
    assert [paths[i] for i in order] == sorted(paths)
