"""Words of any length are scored to their end."""

from __future__ import annotations

from zlib import crc32

import numpy as np

from claimloom.llm import toxicity


def test_all_n_grams_of_a_long_word():
    for word in ("ab" * 500, "字" * 70 + "末尾の言葉", "x" * 63, "x" * 64 + "vilescum"):
        w = f"<{word}>"
        grams = {w} | {w[i : i + k] for k in range(3, 7) for i in range(len(w) - k + 1)}
        assert toxicity.word_rows(word) == sorted({crc32(g.encode("utf-32-le")) % toxicity.BUCKETS for g in grams})


def test_the_end_of_a_long_word_counts():
    share = np.zeros(toxicity.BUCKETS)
    share[toxicity.word_rows("vilescum")] = 2000.0
    model = toxicity.Model(share, -1.0)
    assert model.score("x" * 64 + "vilescum") > model.score("x" * 64 + "niceword")
    assert not model.table  # too long to be kept
