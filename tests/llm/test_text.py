import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import _text

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab AZé9.\t\n-日"), max_size=60)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_spans_and_hashes(texts, limit):
    words, hashes = [[] for _ in texts], {}
    for at, _, data, bounds in _text.chunks(pa.array(texts, pa.string()), limit):
        first, last, row = _text.spans(data, bounds, _text.ALNUM)
        for a, b, r, h in zip(first, last, row, _text.hash_spans(data, first, last, _text.FOLD_ASCII), strict=True):
            word = bytes(data[a:b]).decode()
            words[at + r].append(word)
            low = "".join(c.lower() if c.isascii() else c for c in word)
            assert hashes.setdefault(low, h) == h
    assert words == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_slices_and_pieces():
    texts = pa.array(["zz", "a b", None, "c " * 70_000, "b a"]).slice(1)
    seen = {}
    for _, _, data, bounds in _text.chunks(texts):
        first, last, _ = _text.spans(data, bounds, _text.NON_SPACE)
        for a, b, h in zip(first, last, _text.hash_spans(data, first, last), strict=True):
            assert seen.setdefault(bytes(data[a:b]), h) == h
    assert set(seen) == {b"a", b"b", b"c"}
    assert list(_text.hash_words(["a", "b", "c"])) == [seen[w] for w in (b"a", b"b", b"c")]


def test_windows_and_sliding():
    r = random.Random(2)
    values = [r.randrange(3) for _ in range(200)]
    x = _text.mix(np.array(values, np.uint64))
    for width in (1, 2, 5, 7, 25, 50, 201):
        got = _text.windows(x, width)
        assert len(got) == max(0, 200 - width + 1)
        same = {}
        for i, h in enumerate(got):
            assert same.setdefault(tuple(values[i : i + width]), h) == h
        assert len(set(same.values())) == len(same)
        low = _text.sliding(x, width, np.minimum)
        assert list(low) == [min(x[i : i + width]) for i in range(len(low))]
