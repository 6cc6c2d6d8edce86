"""Vectorised words against a regular expression."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcast.llm import textarrays as ta

WORD = re.compile(ta.WORD_RE)
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé9 ,\n漢-ßZ_", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    column = pa.array(texts, pa.string())
    words = ta.Words(column)
    want = [WORD.findall((t or "").lower()) for t in texts]
    assert words.texts(np.arange(len(words))) == [w for line in want for w in line]
    assert np.diff(words.first).tolist() == [len(line) for line in want]
    assert words.row.tolist() == [k for k, line in enumerate(want) for _ in line]
    by_text = {}
    for w, h in zip([w for line in want for w in line], words.hash.tolist()):
        assert by_text.setdefault(w, h) == h
    assert len(set(by_text.values())) == len(by_text)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4), st.integers(0, 3))
def test_windows_and_slices_of_slices(texts, n, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    words = ta.Words(column)
    h, index = ta.windows_of(words.hash, words.first, n)
    assert index.tolist() == [k for k in range(len(words) - n + 1) if words.row[k] == words.row[k + n - 1]]
    parts = [ta.Words(column.slice(a, b - a)).hash for a, b in ta.slices(column, 10)]
    assert np.concatenate(parts).tolist() == words.hash.tolist() if parts else not len(words)
    assert len(h) == len(index)


def test_a_word_longer_than_the_tables():
    long = "x" * 3_000_000
    a, b = ta.Words(pa.array(["q " + long, "q"])), ta.Words(pa.array([long]))
    assert a.hash[1] == b.hash[0] and a.hash[0] == a.hash[2]
