import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from noticelake.llm import grouped_packing as gp


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(gp.default_tokenizer())


def expected(full, text):
    return np.array([*full.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


HARD = ["<|endoftext|>", "a<|startoftext|>b", "<|endoftext|", "don't we'LL 'tis ''s .'s I'Ve", "A\x1cb\x85c d e", "\x0b\x0c",
        "ÀÉÎ×÷ß ªµº²", "é ̈x", "ΑΣ ΑΣ.Σ", "İstanbul", "世界 🙂👍🏽", "12345 1a2b", "~!@#$%^&*()_+|<>", "​", "ﬁ K Å",
        "x" * 5000, "schß ßa Öß".upper() + "schß ßa Öß", "".join(map(chr, range(0xC0, 0x100))), "ünïcödé" * 300, "a" * 3 + "́"]


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_tokenizers(full, text):
    words = gp.WordTokenizer(gp.default_tokenizer())
    for body in (text, f"the {text} of\n{text}", f"{text},{text}"):
        assert next(words.encode([body.encode()])) == expected(full, body)[:-1].tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.sampled_from(HARD), max_size=5).map(" ".join))
def test_ids_of_any_text(text):
    words = gp.tokenizer(gp.default_tokenizer())
    assert next(words.encode([text.encode()])) == expected(words.full, text)[:-1].tobytes()


def test_tables_are_bounded(monkeypatch, full):
    monkeypatch.setattr(gp, "WORDS", 5)
    monkeypatch.setattr(gp, "PARTS", 3)
    words = gp.WordTokenizer(gp.default_tokenizer())
    for at in range(20):
        body = f"w{at} and x{at}y the, end."
        assert next(words.encode([body.encode()])) == expected(full, body)[:-1].tobytes()
        assert len(words.words) <= 10 and len(words.old_words) <= 10


def naive_first_fit(lengths, capacity):
    bins = []
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[i] for i in b) + lengths[at] <= capacity:
                b.append(at)
                break
        else:
            bins.append([at])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([32, 40]))
def test_the_tree_finds_the_first_bin(lengths, capacity):
    assert gp.first_fit(lengths, capacity) == naive_first_fit(lengths, capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_gaps_are_closed_and_nothing_is_lost(lengths):
    packed = gp.pack_group(lengths, 64)
    fill = [sum(n for _, _, n in s) for s in packed]
    assert fill.count(64) >= sum(lengths) // 64 and all(f & (f - 1) == 0 for f in fill)
    seen = defaultdict(list)
    for s in packed:
        for place, low, n in s:
            seen[place].append((low, low + n))
    for place, n in enumerate(lengths):
        ends = [0] + [high for low, high in sorted(seen[place])]
        assert [low for low, _ in sorted(seen[place])] == ends[:-1] and ends[-1] == n


def check(rows, texts, full, capacity):
    """Every id in one piece, pieces gapless in their sequences, checksums right."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    assert by_doc.keys() == set(texts)
    for doc, bodies in texts.items():
        left = [(expected(full, b)) for b in bodies]
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, left))
        if len(left) == 1:
            ids, at = left[0], 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length


@pytest.mark.parametrize("close", [True, False])
@pytest.mark.parametrize("capacity, group", [(64, 3), (2048, 4096)])
def test_awkward_documents(documents, full, capacity, group, close):
    texts = defaultdict(list)
    for r in documents.collect():
        texts[r.doc_id].append(r.text)
    packed = gp.pack_documents(documents, capacity=capacity, group=group, close_gaps=close)
    check(packed.collect(), texts, full, capacity)
    assert gp.padding(packed, capacity).first().padding == 0 or not close


def test_no_documents(nothing):
    assert gp.pack_documents(nothing).collect() == []


def test_given_documents_have_no_padding_and_few_cuts(spark, sf, full):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    packed = gp.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    check(rows, texts, full, 2048)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows[:200])
    total = gp.padding(packed).first()
    least = sum(-(-r.doc_tokens // 2048) for r in rows if r.start == 0)
    assert total.padding == 0 and len(rows) <= 1.5 * least


def test_text_ids_and_the_same_result_twice(documents):
    docs = documents.select(documents.doc_id.cast("string").alias("doc_id"), "text")
    assert sorted(map(str, gp.pack_documents(docs).collect())) == sorted(map(str, gp.pack_documents(docs).collect()))
