"""Texts are coded a bucket at a time, without a Python object for each token."""

import numpy as np
import pytest

from tractus.llm import lm


@pytest.mark.parametrize("piece", [1, 7, 4 << 20])
def test_bucket_against_tokens(monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    texts = [None, "", "  ", "A b", "\t\n\x0b\x0c\rb  A\n", "", "ß É\x1c x", "longwordlongword " * 3, "b", None]
    bucket = lm.Bucket()
    for t in texts:
        bucket.add(t, True)
    words, w, sizes = bucket._words()
    plain = [[*lm.tokens(t), lm.END_TOKEN] for t in texts]
    assert [words[i] for i in w.tolist()] == [x for ws in plain for x in ws]
    assert sizes.tolist() == [len(ws) for ws in plain]
    assert len(set(words)) == len(words) and words[0] == lm.END_TOKEN


@pytest.mark.parametrize("texts", [[None], ["", ""], [None, "  "]])
def test_bucket_without_words(texts):
    bucket = lm.Bucket()
    for t in texts:
        bucket.add(t, False)
    assert bucket._words()[1].tolist() == [0] * len(texts)


def test_pairs_by_either_sort():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    w = rng.integers(0, 50, 3000).astype(np.int32)
    (u, x, s), at = lm._pairs(w, h, 7)
    assert (x[at] == w).all() and (u[at] == np.concatenate([w[-1:], w[:-1]])).all()
    assert (np.diff(s) >= 0).all() and len(set(zip(u.tolist(), x.tolist()))) == len(u)
    (u2, x2, s2), at2 = lm._pairs(w, h, 1 << 17)
    assert (x2[at2] == w).all() and (u2[at2] == np.concatenate([w[-1:], w[:-1]])).all() and (np.diff(s2) >= 0).all()


def test_packed_arrays_come_back():
    for a in (np.arange(300, dtype=np.int64) << 33, np.zeros(0, np.float32), np.arange(5, dtype=np.int16), np.linspace(0, 1, 9)):
        (b,) = lm.unpacked(lm.packed(a))
        assert b.dtype == a.dtype and (b == a).all()
