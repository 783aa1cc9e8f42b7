"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score
of the piece they would form (ties: the leftmost pair); the best pair is
merged until no pair forms a piece.  Symbols outside the vocabulary fall
back to byte pieces.  No piece holds a space mark after another
character, none holds a line feed and, in some vocabularies, none holds
a letter beside another sign, so a text falls into segments that merges
never cross; a worker encodes each segment once and keeps a
bounded table of them.  Every segment that is new to a worker is checked
against the sentencepiece library, once per Arrow batch.

Defined results: null text is the empty text (begin and end id only);
repeated rows give repeated rows; other columns are left alone.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import trim

SPACE = "▁"
#: Words and segments a task keeps, each (some 200 bytes an entry); beyond
#: it the older half goes.
TABLE_SIZE = 200_000
#: Longer segments are encoded each time instead of being kept.
KEPT_LENGTH = 48
#: Rank of a pair that forms no piece.
NEVER = 1 << 30

codecs.register_error("replace_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    """Encoder and decoder over one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [self.unk] * 256
        self.piece_bytes: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i):
                self.piece_bytes.append(b"")
            elif sp.is_unknown(i):
                self.piece_bytes.append(" ⁇ ".encode())
            elif sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                self.piece_bytes.append(bytes([b]))
            else:
                score[piece] = sp.get_score(i)
                self.ids[piece] = i
                self.piece_bytes.append(piece.replace(SPACE, " ").encode())
        self.plain = frozenset(self.ids.values())
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}
        bodies = [p.lstrip(SPACE) for p in self.ids]
        if any("\n" in p or SPACE in p for p in bodies):
            raise ValueError("pieces span a space or a line feed")
        if any(u.isalpha() != v.isalpha() for p in bodies for u, v in zip(p, p[1:])):
            runs = f"[^{SPACE}\n]+"
        else:
            runs = f"(?:[^\\W\\d_]+|(?:(?![{SPACE}\n])[\\W\\d_])+)"
        self.segments = re.compile(f"{SPACE}*{runs}|\n|{SPACE}+").findall

    def _merge_heap(self, sym: list[str]) -> None:
        """Merge in place with a heap, for long segments.

        An agenda entry is ``rank << 32 | left``: the best score first,
        then the leftmost pair.  An entry is stale when its two symbols
        no longer form a piece of that rank.
        """
        rank = self.rank.get
        n = len(sym)
        agenda = [
            r << 32 | i for i, r in enumerate(map(rank, map(add, sym, sym[1:]))) if r is not None
        ]
        if agenda:
            heapify(agenda)
            before = list(range(-1, n - 1))
            after = list(range(1, n + 1))
            while agenda:
                e = heappop(agenda)
                left = e & 0xFFFFFFFF
                x = sym[left]
                if not x:
                    continue
                right = after[left]
                if right == n:
                    continue
                x += sym[right]
                if rank(x) != e >> 32:
                    continue
                sym[left] = x
                sym[right] = ""
                after[left] = r = after[right]
                if r != n:
                    before[r] = left
                    k = rank(x + sym[r])
                    if k is not None:
                        heappush(agenda, k << 32 | left)
                p = before[left]
                if p >= 0:
                    k = rank(sym[p] + x)
                    if k is not None:
                        heappush(agenda, k << 32 | p)

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the score-ordered agenda.

        A short segment's agenda is the plain list of its pairs' ranks:
        the first smallest entry is the best pair, leftmost on ties.
        """
        got = self.ids.get
        rank = self.rank.get
        sym = list(segment)
        if len(sym) > 40:
            self._merge_heap(sym)
        else:
            agenda = [rank(x, NEVER) for x in map(add, sym, sym[1:])]
            while agenda:
                best = min(agenda)
                if best == NEVER:
                    break
                i = agenda.index(best)
                sym[i] += sym.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = rank(sym[i] + sym[i + 1], NEVER)
                if i:
                    agenda[i - 1] = rank(sym[i - 1] + sym[i], NEVER)
        out = []
        for x in sym:
            if x:
                i = got(x)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(map(self.byte_id.__getitem__, x.encode()))
        return out

    def split(self, text: str) -> list[str]:
        """Segments of the normalised text (dummy space in front)."""
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Begin id, ids of the text, end id."""
        out = [self.bos]
        for s in self.split(text or ""):
            out += self.merge(s)
        out.append(self.eos)
        return out

    def decode_bytes(self, ids) -> bytes:
        """UTF-8 of the decoded text, before invalid bytes are replaced."""
        out = b"".join(map(self.piece_bytes.__getitem__, ids))
        if out[:1] == b" " and next(i for i in ids if self.piece_bytes[i]) in self.plain:
            out = out[1:]
        return out

    def decode(self, ids) -> str:
        """Text of ids: control ids vanish, each byte that is not part of
        valid UTF-8 becomes U+FFFD, the dummy space goes.  Bytes on both
        sides of a control id don't form a character."""
        ids = list(ids)
        runs, at = [], 0
        first = next((i for i in ids if self.piece_bytes[i]), None)
        for k, i in enumerate([*ids, self.bos]):
            if not self.piece_bytes[i]:
                runs.append(b"".join(map(self.piece_bytes.__getitem__, ids[at:k])).decode("utf-8", "replace_each_byte"))
                at = k + 1
        out = "".join(runs)
        return out[1:] if first in self.plain and out[:1] == " " else out

    def check(self, segments: list[str], packed: list[bytes]) -> None:
        """Compare segments' ids with the library's."""
        front = array("I", self.lib.encode("\n")).tobytes()
        for s, mine, theirs in zip(
            segments, packed, self.lib.encode(["\n" + s for s in segments], num_threads=1), strict=True
        ):
            if front + mine != array("I", theirs).tobytes():
                raise ValueError(f"ids differ from the library's for {s!r}")


class _Segments(dict):
    """Packed ids by segment, filled on demand."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.new, self.ids = codec, [], []

    def __missing__(self, segment: str) -> bytes:
        packed = array("I", self.codec.merge(segment)).tobytes()
        self.new.append(segment)
        self.ids.append(packed)
        if len(segment) <= KEPT_LENGTH:
            self[segment] = packed
        return packed


class Table(dict):
    """Packed ids by space-separated word, over a table of segments."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.segments = codec, _Segments(codec)

    def __missing__(self, word: str) -> bytes:
        packed = b"".join(map(self.segments.__getitem__, self.codec.segments(SPACE + word)))
        if len(word) <= KEPT_LENGTH:
            self[word] = packed
        return packed

    def pack(self, text: str | None) -> bytes:
        """Packed ids of a whole text, without begin and end."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or SPACE in text:  # runs of spaces stay together
            return b"".join(map(self.segments.__getitem__, self.codec.split(text)))
        return b"".join(map(self.__getitem__, text.split(" ")))

    def settle(self) -> None:
        """Check what is new; make room where a table is full."""
        x = self.segments
        if x.new:
            self.codec.check(x.new, x.ids)
            x.new, x.ids = [], []
        for d in (self, x):
            if len(d) > TABLE_SIZE:  # the older half goes
                for k in list(islice(d, TABLE_SIZE // 2)):
                    del d[k]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """This worker's codec for a model."""
    return Codec(model_file)


def table(model_file: str) -> Table:
    """A new table over the worker's codec: a task's own, gone with it."""
    return Table(codec(model_file))


def _pack(t: Table, texts: pa.Array) -> list[bytes]:
    """Packed ids of a batch, begin and end included."""
    begin, end = array("I", [t.codec.bos]).tobytes(), array("I", [t.codec.eos]).tobytes()
    packed = [begin + t.pack(x) + end for x in texts.to_pylist()]
    t.settle()
    return packed


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Straight from the bytes: lists of Python integers take many times
    their memory."""
    offsets = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_column(text: Column | str, model_file: str) -> Column:
    """``array<int>`` of ids for a text column (null: empty text)."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(model_file)
        for texts in batches:
            yield _lists(_pack(t, texts))
        del t
        trim()

    return ids(text)


def coded_column(text: Column | str, model_file: str) -> Column:
    """Struct of ``ids`` and ``round_trip``: whether decoding them gives
    the text (null: empty text)."""

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(model_file)
        for texts in batches:
            packed = _pack(t, texts)
            same = [
                t.codec.decode_bytes(array("I", p)).decode("utf-8", "replace_each_byte") == (x or "")
                for p, x in zip(packed, texts.to_pylist())
            ]
            yield pa.StructArray.from_arrays([_lists(packed), pa.array(same, pa.bool_())], ["ids", "round_trip"])
        del t
        trim()

    return coded(text)


def decode_column(ids: Column | str, model_file: str) -> Column:
    """Text of an ``array<int>`` column (null: null)."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        c = codec(model_file)
        return pa.array([None if x is None else c.decode(x) for x in rows.to_pylist()], pa.string())

    return text(ids)


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the decoded text.

    Encodes the whole text, then decodes the ids; ids and text never
    leave the worker, so the result is small.
    """
    from claimloom.llm.common import map_batches

    def make():
        c = codec(model_file)
        t = Table(c)
        begin, end = array("I", [c.bos]).tobytes(), array("I", [c.eos]).tobytes()

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            n, a, b = [], [], []
            for x in batch.column(1).to_pylist():
                packed = begin + t.pack(x) + end
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                plain = c.decode_bytes(array("I", packed))
                b.append(hashlib.sha256(plain.decode("utf-8", "replace_each_byte").encode()).hexdigest())
            t.settle()
            return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text_col), make,
        f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
