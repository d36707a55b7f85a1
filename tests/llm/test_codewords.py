"""Codewords of languages: far enough apart that a wrong bit can be corrected."""

import numpy as np
import pytest

from millwright.llm import langid


@pytest.mark.parametrize("n", [4, 5, 8, 9, 10, 11, 15, 16, 17, 40, 100, 200])
def test_any_two_codewords_differ_in_three_bits(n):
    codes = langid.codewords(n)
    away = (codes[:, None, :] != codes[None, :, :]).sum(axis=2)
    assert set(np.unique(codes)) == {-1, 1} and away[~np.eye(n, dtype=bool)].min() >= 3
    assert codes.shape[1] <= max(langid.BITS, n + 2 * int(np.ceil(np.log2(n))) + 4)
    model = langid.Model([str(i) for i in range(n)], codes, np.zeros((1, codes.shape[1])))
    for bit in range(codes.shape[1]):  # one wrong bit of any language
        margins = codes.astype(float)
        margins[:, bit] *= -1
        best, _ = model.decode(margins, np.ones(n))
        assert (best == np.arange(n)).all()


def test_few_languages():
    assert [langid.codewords(n).shape[0] for n in (0, 1, 2, 3)] == [0, 1, 2, 3]
