"""Words of any length are counted to their end."""

from __future__ import annotations

from claimloom.llm import sentencepiece_codec, token_counts
from claimloom.llm.queries import piece_model
from tests.llm.test_codec_and_counts import greedy
from tests.llm.util import docs


def test_long_words_are_counted_whole(spark):
    pieces = set(sentencepiece_codec.table(piece_model()).codec.ids)
    words = ["x" * 201, "unbrokentext" * 40, "ab" * 2000, "ab" * 300 + ""]
    want = [greedy(pieces, w) for w in words]
    assert min(want[:3]) > 1 and want[3] == 0
    got = token_counts.token_counts(docs(spark, list(enumerate(words))), piece_model()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_unknown) for r in got) == [(i, max(n, 1), int(n == 0)) for i, n in enumerate(want)]
