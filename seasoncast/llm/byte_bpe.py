"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

Every prefix of a piece has one encoding, so it has one last token: the one token that ends the
prefix and is a valid neighbour of the last token of what comes before it. Two tokens are valid
neighbours if encoding their joined bytes gives the two back. A table of last tokens is hence
enough to encode, to append, and to go on after an edit.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from seasoncast.llm.common import SLICE_ROWS, map_slices
from seasoncast.llm.memo import AgingMemo, Memo


# Lengths to try where no longer token has the last three bytes.
_SHORT = (2, 1)


class PrefixBpe:
    """Encoder by ranks. ``ranks`` maps token bytes to ids; all 256 single bytes are among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], {1, 2}).add(len(token))
        # Lengths to try by the last three bytes, long ones first.
        self._lengths = {end: sorted(n, reverse=True) for end, n in lengths.items()}
        self._decimal = {i: str(i) for i in self.tokens}
        self._id_bytes = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self._size = {i: len(t) for t, i in ranks.items()}
        self._endings: ahocorasick.Automaton | None = None
        self._halves = Memo(self._last_merge, limit=len(ranks))
        self._neighbours = Memo(self._are_neighbours, limit=250_000)
        self._pieces = AgingMemo(self._piece, limit=100_000)
        self._lone = AgingMemo(self._lone_part, limit=30_000)
        self._spaced = AgingMemo(lambda part: self._lone_part(" " + part, 1), limit=250_000)
        self._newline = self._pieces["\n"]

    @classmethod
    def read(cls, path: str, pattern: str) -> PrefixBpe:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merged(self, raw: bytes, below: int | None = None) -> list[bytes]:
        """Merges by rank until none is left: the definition of the encoding. With ``below``, only
        merges of a lower rank."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks, none = self.ranks, len(self.ranks) + 1
        while len(parts) > 1:
            joined = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == none or (below is not None and best >= below):
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, token: bytes) -> tuple[int, bytes, bytes]:
        """Rank of the merge that makes a token, and its two halves; -1 for what no merge makes."""
        parts = self.merged(token, self.ranks[token]) if len(token) > 1 else [token]
        return (self.ranks[token], *parts) if len(parts) == 2 else (-1, token, token)

    def _are_neighbours(self, pair: int) -> bool:
        """Whether no merge over the border comes before one of those that made the two tokens,
        whose ids are the upper and the lower half of ``pair``.

        Their merges next to the border are undone, the latest first. Where the halves that meet
        there make a token whose merge comes before the one just undone, it would have come first;
        of equal merges the left one comes first.
        """
        left, right = self.tokens[pair >> 32], self.tokens[pair & 0xFFFFFFFF]
        halves, ranks = self._halves, self.ranks
        undone, at_left = len(ranks) + 1, False
        while True:
            over = ranks.get(left + right)
            if over is not None and (over < undone or (over == undone and not at_left)):
                return False
            (one, _, inner), (two, outer, _) = halves[left], halves[right]
            if one < 0 and two < 0:
                return True
            at_left = one > two
            if at_left:
                undone, left = one, inner
            else:
                undone, right = two, outer

    def last_ids(self, raw: bytes) -> list[int]:
        """Id of the last token of each non-empty prefix.

        One run over the bytes names all tokens that end at each of them; of these, the one that is
        a valid neighbour of the last token before it is the prefix's.
        """
        if self._endings is None:
            self._endings = ahocorasick.Automaton()
            for i, token in self.tokens.items():
                self._endings.add_word(token.decode("latin-1"), (len(token), i))
            self._endings.make_automaton()
        last, neighbours = [-1] * len(raw), self._neighbours
        for end, (n, own) in self._endings.iter(raw.decode("latin-1")):
            if last[end] < 0 and (n > end or neighbours[last[end - n] << 32 | own]):
                last[end] = own
        return last

    def last_tokens(self, raw: bytes, known: list[bytes] | None = None) -> list[bytes]:
        """Last token of each non-empty prefix; ``known`` are those of a beginning of ``raw``."""
        if not known:
            return [self.tokens[i] for i in self.last_ids(raw)]
        last = list(known)
        ranks, lengths, neighbours = self.ranks, self._lengths, self._neighbours
        for end in range(len(last) + 1, len(raw) + 1):
            for n in lengths.get(raw[max(0, end - 3) : end], _SHORT):
                token = raw[end - n : end] if n <= end else None
                if token in ranks and (
                    n == end or neighbours[ranks[last[end - n - 1]] << 32 | ranks[token]]
                ):
                    last.append(token)
                    break
        return last

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if raw in self._id_bytes:
            return self._id_bytes[raw]
        last, size, end, ids = self.last_ids(raw), self._size, len(raw), []
        while end:
            ids.append(last[end - 1])
            end -= size[ids[-1]]
        ids.reverse()
        return array("i", ids).tobytes()

    def _lone_part(self, part: str, head: int = 0) -> bytes:
        if part[head].isspace() or part[-1].isspace():
            raise _NeedsContext
        return b"".join(self._pieces.all(self.pattern.findall(part)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; null counts as empty.

        White space that is a single blank or line feed between other characters cuts the text
        into parts that the pattern treats alone; any other text is matched as a whole.
        """
        if not text:
            return b""
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self._lone[first] + b"".join(self._spaced.all(rest)))
            return self._newline.join(lines)
        except (_NeedsContext, IndexError):
            return b"".join(self._pieces.all(self.pattern.findall(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of their decimals joined by blanks and of what they decode to."""
        ids = np.frombuffer(self.encode(text), dtype="<i4").tolist()
        listed = " ".join(map(self._decimal.__getitem__, ids))
        return len(ids), sha256(listed.encode()).hexdigest(), sha256(self.decode(ids)).hexdigest()


class _NeedsContext(Exception):
    """White space at the end of a part: what it matches depends on its neighbours."""


def walk_back(raw: bytes, last: list[bytes]) -> list[bytes]:
    """Tokens of the whole, read from the table of last tokens."""
    out, end = [], len(raw)
    while end:
        out.append(last[end - 1])
        end -= len(out[-1])
    return out[::-1]


class PieceTable:
    """One piece with its table: tokens at once, exact appends, re-encoding near an edit."""

    def __init__(self, bpe: PrefixBpe, raw: bytes = b""):
        self.bpe, self.raw, self.last = bpe, raw, bpe.last_tokens(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.last = self.bpe.last_tokens(self.raw, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace ``raw[start:stop]``. Prefixes before it keep their tokens; after it the table
        is computed until it repeats the old one over the length of the longest token."""
        old, shift = self.last, len(new) - (stop - start)
        self.raw = self.raw[:start] + new + self.raw[stop:]
        last, same, end = old[:start], 0, start + len(new)
        last = self.bpe.last_tokens(self.raw[:end], last)
        while len(last) < len(self.raw):
            at = len(last)
            last = self.bpe.last_tokens(self.raw[: at + 1], last)
            same = same + 1 if last[at] == old[at - shift] else 0
            if same >= self.bpe.longest:
                last += old[at + 1 - shift :]
        self.last = last

    def tokens(self) -> list[bytes]:
        return walk_back(self.raw, self.last)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> PrefixBpe:
    """One encoder a worker process."""
    return PrefixBpe.read(path, pattern)


def encode(
    rows: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    out: str = "ids",
    keep_text: bool = True,
) -> DataFrame:
    """``rows`` with token ids of whole texts in ``out`` (``array<int>``; replaced if it is there).

    Null and empty texts have no ids. Texts are encoded once, a few at a time, and come back only
    with ``keep_text``.
    """

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        raw = [bpe.encode(t) for t in batch.column(at).to_pylist()]
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
        ids = pa.ListArray.from_arrays(pa.array(ends), values)
        columns = [batch.column(i) for i in kept]
        return pa.record_batch([*columns, ids], names=[*(names[i] for i in kept), out])

    given = rows.select(*[c for c in rows.columns if c != out])
    names = given.columns
    at = names.index(text)
    kept = [i for i in range(len(names)) if keep_text or i != at]
    fields = [given.schema.fields[i] for i in kept]
    schema = StructType([*fields, StructField(out, ArrayType(IntegerType()))])
    return map_slices(given, add, schema)


def digests(text: Column, path: str, pattern: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>`` of whole texts, encoded and decoded in one
    pass that gives out nothing but these. Null and empty texts have no ids."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def made(texts: pa.Array) -> pa.Array:
        bpe = load(path, pattern)
        rows = [bpe.digests(t.as_py()) for t in texts]
        n, ids, raw = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return made(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of token ids; null has none. An id outside the vocabulary raises."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        bpe = load(path, pattern)
        texts: list[bytes] = []
        for start in range(0, len(lists), SLICE_ROWS):
            some = lists.slice(start, SLICE_ROWS)
            ids = some.flatten().to_numpy(zero_copy_only=False).tolist()
            sizes = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes).tolist()
            texts += [bpe.decode(ids[a:b]) for a, b in zip([0, *ends], ends)]
        return pa.array(texts, pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return raw(ids)
