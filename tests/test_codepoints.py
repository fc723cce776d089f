import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lavra.functions import codepoints as cp

ALPHABET = "aéÀ ñ́ﬁ½²…ßİΣ𝔸😀١1_-\n 한ªº"


def split(text):
    out, now = [], ""
    for c in text + "\0":
        if cp.char_class(c) in (cp.LETTER, cp.DIGIT):
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=12)), max_size=8), st.integers(1, 60))
def test_fold_and_words_agree_with_the_scalar_version(texts, size):
    seen = 0
    for off, part in cp.pieces(pa.array(texts, pa.string()), size):
        codes, bounds = cp.fold(*cp.decode(part))
        start, end, row = cp.words(codes, bounds)
        for i in range(len(part)):
            folded = cp.fold_text(texts[off + i] or "")
            assert "".join(map(chr, codes[bounds[i] : bounds[i + 1]])) == folded
            assert ["".join(map(chr, codes[a:b])) for a, b, r in zip(start, end, row) if r == i] == split(folded)
        seen += len(part)
    assert seen == len(texts)


def test_equal_spans_have_equal_hashes_wherever_they_lie():
    codes, bounds = cp.decode(pa.array(["abcxabc", "zabc", "abd"]))
    sums = cp.prefix_hash(codes)
    h = cp.span_hashes(sums, np.array([0, 4, 8, 11]), np.array([3, 7, 11, 14]))
    assert h[0] == h[1] == h[2] != h[3]
    assert bounds.tolist() == [0, 7, 11, 14]


def test_empty_columns():
    for texts in ([], [None], ["", None, ""]):
        for _, part in cp.pieces(pa.array(texts, pa.string())):
            codes, bounds = cp.fold(*cp.decode(part))
            assert not len(codes) and not bounds.any()
            assert not len(cp.words(codes, bounds)[0])
