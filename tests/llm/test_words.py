import re

import numpy as np
from hypothesis import given, settings, strategies as st

from noticelake.llm import words as W


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b\x1c 世", max_size=80), st.integers(1, 5))
def test_equal_windows_have_equal_hashes(text, size):
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends = W.spans(buf)
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == words
    hashes = W.window_hashes(W.word_hashes(buf, starts, ends), size)
    grams = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    assert len(hashes) == len(grams)
    assert len(set(hashes.tolist())) == len(set(grams))
    assert {(g, h) for g, h in zip(grams, hashes.tolist())}.__len__() == len(set(grams))


def test_segments_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 37}" for i in range(900)) + " " + "z" * 500
    buf = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(W, "SEGMENT", 256)
    W._family.cache_clear()
    small = W.word_hashes(buf, *W.spans(buf))
    windows = W.window_hashes(small, 5)
    monkeypatch.undo()
    W._family.cache_clear()
    whole = W.word_hashes(buf, *W.spans(buf))
    assert (small[:-1] == whole[:-1]).all() and (windows[:-1] == W.window_hashes(whole, 5)[:-1]).all()


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 60))
def test_sliding_min(values, size):
    if size <= len(values):
        found = W.sliding_min(np.array(values), size)
        assert found.tolist() == [min(values[i:i + size]) for i in range(len(values) - size + 1)]
