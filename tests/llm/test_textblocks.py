from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import textblocks as tb

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té日", max_size=30)), max_size=12)


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_words_and_lines(texts):
    at = 0
    for block in tb.blocks(pa.array(texts, pa.string()), 20):
        w, ls = tb.words(block), tb.lines(block)
        assert block.first == at
        for i, text in enumerate(texts[block.first : block.last]):
            data = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
            assert data == (text or "").encode()
            found = [block.data[a:b].tobytes() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
            assert found == [x.encode() for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
            split = [block.data[a:b].tobytes() for a, b in zip(ls.starts[ls.first[i] : ls.first[i + 1]], ls.ends[ls.first[i] : ls.first[i + 1]], strict=True)]
            assert split == (text or "").encode().split(b"\n")
        at = block.last
    assert at == len(texts)


def test_hashes_follow_the_bytes():
    block = next(tb.blocks(pa.array(["ab Ab ab", "AB abc a"])))
    h = tb.word_hashes(block, tb.words(block))
    assert h[0] == h[2] and len(set(h.tolist())) == 5
    low = tb.word_hashes(block, tb.words(block), lower=True)
    assert len(set(low.tolist())) == 3
    assert tb.repeats_earlier(np.array([0, 0, 0, 1]), h[[0, 1, 2, 0]]).tolist() == [False, False, True, False]
