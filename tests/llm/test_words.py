import numpy as np
import pyarrow as pa

from llm_cases import awkward, words  # noqa: F401
from shelfwise.llm.words import shingles, texts



def test_words_of_whole_texts(awkward):
    column = pa.array([t for _, t in awkward])
    for size in (1, 50, 1 << 20):
        got = [[] for _ in awkward]
        seen = {}
        for text in texts(column, size=size):
            row, start, end = text.words()
            for r, s, e, h in zip(row, start, end, text.hashes(start, end).tolist()):
                word = text.string(s, e)
                got[text.first + r].append(word)
                assert seen.setdefault(word, h) == h
        assert got == [words(t) for _, t in awkward]
        assert len(set(seen.values())) == len(seen)


def test_shingles_stay_within_rows():
    row = np.array([0, 0, 0, 1, 1, 2])
    at, h = shingles(row, np.arange(6, dtype=np.uint64), 2)
    assert at.tolist() == [0, 1, 3] and len(set(h.tolist())) == 3
    assert len(shingles(row, np.arange(6, dtype=np.uint64), 9)[0]) == 0
