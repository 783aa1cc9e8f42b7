"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie; every node has a failure link - the node that
remains after the longest pieces that start at the word's beginning are
popped - and the number of pieces popped on the way.  A word is read
once, sign by sign: where the trie has no edge, the popped pieces are
counted and the failure link followed.  Pieces are never built.

Word-initial pieces carry a space mark in front, others continue a word.
A word that the vocabulary can't cover counts as one unknown token; words
are what lies between white space, of any length.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.common import map_batches

MARK = "▁"
#: Signs of a word that is still counted: there is no limit.
LONGEST = inf
#: Signs of a word that a worker keeps; longer ones are counted each time.
KEPT = 200
#: Words a worker keeps; beyond it the older half goes.
TABLE_SIZE = 500_000
#: State after a word that can't be covered.
DEAD = -1


class Automaton:
    """Trie with failure links and popped counts over pieces."""

    def __init__(self, pieces: list[str]):
        # two roots: 0 before a word (its pieces start with the mark), 1 inside one
        self.edges: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for piece in pieces:
            at = 0 if piece.startswith(MARK) else 1
            for c in piece:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                    parent.append((at, c))
                at = nxt
            final[at] = True
        self.fail, self.popped = [DEAD] * len(self.edges), [0] * len(self.edges)
        order, at = [0, 1], 0
        while at < len(order):
            order += self.edges[order[at]].values()
            at += 1
        for v in order[2:]:
            if final[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            u, c = parent[v]
            n, z = self.popped[u], self.fail[u]
            while z != DEAD and c not in self.edges[z]:
                n, z = n + self.popped[z], self.fail[z]
            if z != DEAD:
                self.fail[v], self.popped[v] = self.edges[z][c], n

    def count(self, word: str) -> int:
        """Number of pieces of a word, 0 if it can't be covered."""
        edges, fail, popped = self.edges, self.fail, self.popped
        n, at = 0, 0
        for c in MARK + word:
            nxt = edges[at].get(c)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at == DEAD:
                    return 0
                nxt = edges[at].get(c)
            at = nxt
        while at != 1:  # pop what is left
            n += popped[at]
            at = fail[at]
            if at == DEAD:
                return 0
        return n


class _Counts(dict):
    """Pieces by word, filled on demand."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= KEPT:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def table(model_file: str) -> _Counts:
    """This worker's table over the normal pieces of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    return _Counts(Automaton([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)]))


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_tokens``, ``n_unknown``.

    Whole texts; null and empty texts count zero; repeated rows give a
    row each; other columns are left alone.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        t = table(model_file)

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            words, tokens, unknown = [], [], []
            for x in batch.column(1).to_pylist():
                n = list(map(t.__getitem__, (x or "").split()))
                none = n.count(0)
                words.append(len(n))
                tokens.append(sum(n) + none)
                unknown.append(none)
                if len(t) > TABLE_SIZE:
                    for k in list(islice(t, TABLE_SIZE // 2)):
                        del t[k]
            return {id_col: batch.column(0), "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

        return run

    return map_batches(
        docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    )
