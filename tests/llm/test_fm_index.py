import numpy as np
import pytest

from domquarry.llm.fm_index import Bits, FMIndex, WaveletMatrix, suffix_array


def test_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000):
        b = rng.integers(0, 2, n).astype(bool)
        i = np.arange(n + 1)
        assert (Bits(b).rank1(i) == np.concatenate([[0], np.cumsum(b)])).all()
        assert (Bits(b).get(np.arange(n)) == b).all()


def test_wavelet():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = WaveletMatrix(s, 37)
    assert (w.access(np.arange(500)) == s).all()
    for c in range(37):
        i = np.arange(501)
        assert (w.rank(np.full(501, c), i) == np.concatenate([[0], np.cumsum(s == c)])).all()


def test_suffixes():
    s = np.append(np.random.default_rng(2).integers(1, 3, 200), 0)
    assert suffix_array(s).tolist() == sorted(range(201), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("sigma", [2, 3, 20])
def test_search(sigma):
    rng = np.random.default_rng(3)
    s = rng.integers(1, sigma + 1, 400)
    index = FMIndex(s, sigma + 1, sample=5)
    for length in (1, 3, 7):
        patterns = np.stack([s[i : i + length] for i in rng.integers(0, 390, 20)] + [rng.integers(1, sigma + 1, length) for _ in range(5)])
        which, at = index.locate(*index.search(patterns))
        for k, p in enumerate(patterns):
            assert sorted(at[which == k]) == [i for i in range(400 - length + 1) if (s[i : i + length] == p).all()]
