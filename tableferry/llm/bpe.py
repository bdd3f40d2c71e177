"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end a valid encoding of that prefix.
Storing this last token per prefix gives the encoding of every prefix at once: appending bytes
only adds entries, and an edit only recomputes entries from its own place on.

Nulls and empty texts encode to no tokens. Texts and pieces may be of any length: work grows with their bytes,
and memory holds one text's tokens. Repeated rows give repeated results, extra columns are kept by
:func:`encode` whatever their names (one called ``ids`` is replaced), and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Distinct pieces that a worker keeps encoded in each of two stores: when the new one is full it becomes
#: the old one, from which pieces that are met again move on.
KEPT_PIECES = 100_000
#: Pairs of tokens whose order is kept as known, so many at once.
KEPT_PAIRS = 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the token's bytes, then its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBpe:
    """Encoder over pieces of bytes, by the last valid token of each prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.sizes.values(), default=1)
        #: Tokens as texts of one character a byte: finds all that end at a place, the longest first.
        self.endings = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.endings.add_word(token.decode("latin-1"), i)
        self.endings.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._joins: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one; (token, token) for a byte; None if
        merging its bytes never yields it."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.tokens[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
                if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            ids = [self.ranks[x] for x in parts]
            self._halves[token] = (token, token) if len(ids) == 1 else (ids[0], ids[1]) if len(ids) == 2 else None
        return self._halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side: undoing them from the later one
        on, no merge across the border may come earlier than those that formed the tokens."""
        key = left << 32 | right
        bound, good = 1 << 60, None if self.halves(right) else False
        while good is None:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                good = False
                break
            a, b = self.halves(left), self.halves(right)
            whole_left, whole_right = a[0] == left, b[0] == right
            if whole_left and whole_right:
                good = True
            elif not whole_left and (left > right or whole_right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]
        if len(self._joins) > KEPT_PAIRS:
            self._joins.clear()
        self._joins[key] = good
        return good

    def extend(self, piece: bytes, last: list[int], start: int, end: int) -> list[int]:
        """``last[k]`` is the last token of prefix k; fills start+1..end."""
        sizes, joins, done = self.sizes, self._joins, start
        for at, token in self.endings.iter(piece.decode("latin-1"), max(0, start + 1 - self.longest), end):
            if at != done:
                if at < done:
                    continue
                break
            begin = at + 1 - sizes[token]
            if begin:
                good = joins.get(last[begin] << 32 | token)
                if good is None:
                    good = self.follows(last[begin], token)
            else:
                good = self.halves(token) is not None
            if good:
                done = at + 1
                last[done] = token
        if done < end:
            raise ValueError(f"no valid last token for a prefix of {done + 1} bytes")
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        return self.unwind(self.extend(piece, [-1] * (n + 1), 0, n), n)

    def unwind(self, last: list[int], k: int) -> list[int]:
        out, sizes = [], self.sizes
        while k:
            out.append(last[k])
            k -= sizes[last[k]]
        return out[::-1]


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.bpe.encode_piece(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        self[piece] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def rest(self) -> None:
        """Between tasks one store is enough."""
        self.old = {}


class Codec:
    """Texts to ids and back; ids travel as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.bpe = PrefixBpe(read_ranks(rank_file))
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self.bpe)

    def encode(self, text: str) -> bytes:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.turn()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoding:
    """A text with its pieces, for exact appends and edits that re-encode only near the change."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.ends = [m.end() for m in codec.pattern.finditer(text)]

    def ids(self) -> bytes:
        begin, out = 0, []
        for end in self.ends:
            out.append(self.codec.pieces[self.text[begin:end]])
            begin = end
        return b"".join(out)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]. Splitting restarts one piece before the edit, as a piece looks one
        character ahead, and stops where its borders meet the old ones again."""
        import bisect

        k = max(0, bisect.bisect_left(self.ends, start) - 1)
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        old, fresh, at = {e + shift: i for i, e in enumerate(self.ends) if e >= end}, [], self.ends[k - 1] if k else 0
        tail: list[int] = []
        for m in self.codec.pattern.finditer(text, at):
            fresh.append(m.end())
            if m.end() > start + len(new) and m.end() in old:
                tail = [e + shift for e in self.ends[old[m.end()] + 1 :]]
                break
        self.text, self.ends = text, self.ends[:k] + fresh + tail


_codecs: dict[int, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = hash((rank_file, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a binary column of ids. The rank file has a fixed size, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(b"").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in sliced(batches):
            ids = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, into])
        codec.pieces.rest()

    return docs.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids: key, n_tokens, ids_sha256, decoded_sha256, is_exact."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in sliced(batches):
            n, ids_sha, text_sha, exact = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t := t or "")
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                exact.append(back == t.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "is_exact"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, is_exact boolean")
