import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from noticelake.llm import packing


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1).astype(np.int64)


def fewest(lengths, capacity):
    """Brute force over assignments, longest first."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, left + [room - lengths[i]])
        place(i + 1, rooms + [capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def bins(plan, lengths, capacity):
    used = [size for pattern, times in plan for _ in range(times) for size in pattern]
    assert sorted(used) == sorted(lengths) and all(sum(p) <= capacity and t > 0 for p, t in plan)
    return sum(t for _, t in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_as_few_as_brute_force(lengths):
    counts = histogram(lengths, 30)
    best = fewest(lengths, 30)
    assert packing.lower_bound(counts) <= best
    assert best <= bins(packing.plan(counts), lengths, 30) <= bins(packing.best_fit(counts), lengths, 30)


def test_branching_beats_best_fit():
    lengths = [60, 50, 30, 20, 20, 20] * 3  # best fit decreasing takes more than the total needs
    counts = histogram(lengths, 100)
    assert bins(packing.plan(counts), lengths, 100) == packing.lower_bound(counts) == 6


def test_completions_are_undominated():
    counts = histogram([60, 40, 39, 20, 20, 10], 100)
    assert packing.completions(counts, 60, 100)[0] == (40,)
    assert all(f != (39,) for f in packing.completions(counts, 60, 100))
    assert packing.completions(counts, 60, 0) in ([(40,), (20, 20)], [(40,)])


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_characters_split_alike(full):
    encode = packing.tokenizer(*packing.default_tokenizer())
    chars = [chr(c) for c in range(packing.PLAIN)]
    for a in chars:
        text = "".join(f"{a}{b}x {a}{b} {b}{a}{a}1{a}\n{b}  " for b in chars[::23])
        assert encode(text).tolist() == full(text)


def test_added_tokens_are_one_id_in_both_paths(full):
    encode = packing.tokenizer(*packing.default_tokenizer())
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275] == full("a <|endoftext|> b")
    slow = packing.tokenizer(packing.default_tokenizer()[0], None)
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "世<|endoftext|>界", "<|endoftext|>" * 300):
        assert encode(text).tolist() == slow(text).tolist() == full(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "plain words"])).map("".join))
def test_any_text_has_the_same_ids(text):
    from tokenizers import Tokenizer
    import public_tokenizers
    global _full
    if "_full" not in globals():
        _full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.tokenizer(*packing.default_tokenizer())
    assert encode(text).tolist() == _full.encode(text, add_special_tokens=False).ids


def test_awkward_rows(documents, nothing, full):
    found = packing.pack_documents(documents, capacity=256, with_ids=True).collect()
    texts = sorted(full(r.text or "") + [0] for r in documents.collect())
    by_doc = {}
    sequences = {}
    for r in found:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 256
        by_doc.setdefault((r.doc_id, r.piece, r.start), []).append(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 256
    long = max(texts, key=len)
    parts = sorted((r.start, r.ids) for r in found if r.doc_id == 6 and len([x for x in found if x.doc_id == 6]) > 2 and (r.piece or len(r.ids) == len(long) % 256))
    assert [i for _, ids in parts for i in ids] == long
    assert sum(len(t) for t in texts) == sum(r.length for r in found)
    assert packing.pack_documents(nothing).count() == 0


def test_sequences(documents):
    packed = packing.pack_documents(documents, capacity=512, with_ids=True)
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()} == {
        r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
