"""Tokens of two tokenizers over the same bytes: groups, links, and how common each link is.

Both tokenizations of a text are arrays of end offsets. Where the ends at the current indices are
equal, probes of doubling length compare both arrays at the current index shift and jump the whole
one-to-one stretch. Where they differ, the group is walked up to the next common end, which
updates the shift. Each end met is a move; groups and links are read off the moves as arrays.
Overlapping tokens are linked. How often an id pair is linked in the corpus is
counted over blocks of documents: a block's different pairs are far fewer than its links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence, Sized
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.common import slices
from seasoncast.llm.word_bpe import _byte_of_char
from seasoncast.sources.shared import cut_lineage

#: Links and documents of a block.
BLOCK_LINKS, BLOCK_DOCS = 1_000_000, 4_096
#: Bytes of text that are tokenised at once, besides the document that reaches them.
SLICE_BYTES = 1 << 20
#: An id pair is one number: the first id times this, plus the second.
BASE = 1 << 31

_CHUNK = re.compile(r" +[^ ]*")
# Other white space, a blank, and white space again: the first tokenizer may make one token of it.
_NOT_ALONE = re.compile(r"[^\S ] (?:\s|$)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteTokenizer:
    """Byte-level BPE from a ``tokenizers`` file. Special strings inside texts are plain text.

    Merges run in ``tiktoken`` over the same vocabulary, which is the same where ids follow the
    order of merges; any other file is refused.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if set(t) <= set(byte)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [bytes(byte[c] for c in a + b) for a, b in pairs]
        ids = [vocab[t] for t in merged]
        if ids != sorted(ids) or (ids and ids[0] < 256):
            raise ValueError(f"ids of {path} do not follow its merges")
        ranks = {t: i for t, i in vocab.items() if len(t) == 1} | dict(zip(merged, ids))
        self._core = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def encode(self, text: str) -> list[int]:
        return self._core.encode_ordinary(text)


class PieceTokenizer:
    """A ``sentencepiece`` model that puts a blank before the text."""

    def __init__(self, path: str):
        self._core = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._core.id_to_piece(i) for i in range(self._core.get_piece_size())]
        self.bytes = [self._raw(p) for p in pieces]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        # No piece goes on over a blank, so what stands between blanks is tokenised alone.
        self.by_chunk = not any("▁" in p.lstrip("▁") for p in pieces)
        self._blank = self._core.piece_to_id("▁")

    @staticmethod
    def _raw(piece: str) -> bytes:
        if found := _BYTE_PIECE.fullmatch(piece):
            return bytes([int(found[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank: the one that the model adds."""
        found = self._core.encode([t[1:] for t in texts], num_threads=1)
        return [ids if len(t) > 1 else [self._blank] for t, ids in zip(texts, found)]


class Tokenized(NamedTuple):
    """Ids of both tokenizers, as arrays of 32-bit integers."""

    a: np.ndarray
    b: np.ndarray


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts``, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _sizes(found: Iterable[Sized]) -> np.ndarray:
    return np.fromiter(map(len, found), np.int64)


class TokenizerPair:
    """Both tokenizations of texts, with a memo for what stands between blanks.

    Chunks of up to ``longest`` characters are kept until ``limit`` newer ones, or ``room`` bytes
    of their ids, were met; results never depend on what is kept.
    """

    def __init__(
        self,
        first: str,
        pattern: str,
        second: str,
        limit: int = 100_000,
        longest: int = 64,
        room: int = 8 << 20,
    ):
        self.first, self.second = ByteTokenizer(first, pattern), PieceTokenizer(second)
        self.limit, self.longest, self.room = limit, longest, room
        # By chunk, as bytes of 32-bit integers: how many ids of the first, those ids, those of the
        # second. Empty if the second does not give the chunk back. Keys lack their first blank.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0
        most = max(len(self.first.lengths), len(self.second.lengths))
        self.decimals = np.arange(most).astype(f"S{len(str(most - 1))}")

    def forget(self) -> None:
        self._known, self._older, self._held = {}, {}, 0

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.second.by_chunk:
            return [text]
        spaced = " " + text
        if "  " in spaced:
            return [c[1:] for c in _CHUNK.findall(spaced)]
        return text.split(" ")

    def _learn(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """The first tokenizer reads the chunks in a row, if no token can cross them."""
        spaced = [" " + c for c in chunks]
        raw, row = [c.encode() for c in spaced], "".join(spaced)
        if not self.second.by_chunk or "  " in row or _NOT_ALONE.search(row):
            firsts = [self.first.encode(c) for c in spaced]
            a, n_a = np.array([*chain.from_iterable(firsts)], np.int32), _sizes(firsts)
        else:
            a = np.array(self.first.encode(row), np.int32)
            ends = np.cumsum(self.first.lengths[a])
            n_a = np.diff(np.searchsorted(ends, np.cumsum(_sizes(raw))) + 1, prepend=0)
        seconds = self.second.encode_all(spaced)
        b, n_b = np.array([*chain.from_iterable(seconds)], np.int32), _sizes(seconds)
        stops = np.cumsum(1 + n_a + n_b)
        starts = stops - 1 - n_a - n_b
        flat = np.empty(len(chunks) + len(a) + len(b), np.int32)
        flat[starts] = n_a
        flat[_ranges(starts + 1, n_a)] = a
        flat[_ranges(starts + 1 + n_a, n_b)] = b
        packed, i = flat.tobytes(), 0
        spelled = self.second.bytes.__getitem__
        for chunk, r, ids, i_to in zip(chunks, raw, seconds, (4 * stops).tolist()):
            same = b"".join(map(spelled, ids)) == r
            yield chunk, packed[i:i_to] if same else b""
            i = i_to

    def _look_up(self, chunks: Iterable[str]) -> list[bytes]:
        known, older, fresh = self._known, self._older, []
        found = {}
        for chunk in chunks:
            own = known.get(chunk)
            if own is None:
                own = older.get(chunk)
                if own is None:
                    fresh.append(chunk)
                else:
                    known[chunk] = own
                    self._held += len(own)
            found[chunk] = own
        if fresh:
            for chunk, own in self._learn(fresh):
                found[chunk] = own
                if len(chunk) < self.longest:
                    known[chunk] = own
                    self._held += len(own)
        if len(known) >= self.limit or self._held >= self.room:
            self._known, self._older, self._held = {}, known, 0
        return list(found.values())

    def tokens(self, texts: list[str | None]) -> list[Tokenized | None]:
        """None for null and empty texts, and for those that the second does not give back."""
        chunked = [self._chunks(t) for t in texts]
        place = {c: n for n, c in enumerate(dict.fromkeys(chain.from_iterable(chunked)))}
        found = self._look_up(place)
        flat = np.frombuffer(b"".join(found), np.int32)
        sizes = _sizes(found) // 4
        lost = sizes == 0
        starts = np.cumsum(sizes) - sizes
        n_a = np.zeros(len(found), np.int64)
        n_a[~lost] = flat[starts[~lost]]
        n_b = np.maximum(sizes - 1, 0) - n_a
        out: list[Tokenized | None] = []
        for text, chunks in zip(texts, chunked):
            at = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
            if not chunks or lost[at].any():
                out.append(None)
                continue
            if self.second.by_chunk and _NOT_ALONE.search(text):
                a = np.array(self.first.encode(" " + text), np.int32)
            else:
                a = flat[_ranges(starts[at] + 1, n_a[at])]
            out.append(Tokenized(a, flat[_ranges(starts[at] + 1 + n_a[at], n_b[at])]))
        return out


@lru_cache(maxsize=1)
def _pair(first: str, pattern: str, second: str) -> TokenizerPair:
    return TokenizerPair(first, pattern, second)


def stretch(a: list[int], b: list[int], i: int, j: int) -> int:
    """Length of the one-to-one stretch at ``i, j``, where ends are equal, at the shift ``j - i``."""
    n, step = 1, 8
    while True:
        part, other = a[i + n : i + n + step], b[j + n : j + n + step]
        if part != other or not part:
            break
        n += len(part)
        step *= 2
    # The first unequal ends lie within the last probe.
    for x, y in zip(part, other):
        if x != y:
            break
        n += 1
    return n


class Aligned(NamedTuple):
    groups: str  # decimal ids, as a1,a2|b1;a3|b2,b3
    n_groups: int
    pairs: np.ndarray  # a * BASE + b for every link


#: What ends at a link: its first token, its second, or both.
A_ENDS, B_ENDS, BOTH_END = b"\1", b"\2", b"\3"


def walk(a_ends: list[int], b_ends: list[int]) -> bytearray:
    """What ends at each link, in order. Both end at the same offset."""
    i = j = 0
    last = len(a_ends)
    moves = bytearray()
    while i < last:
        x, y = a_ends[i], b_ends[j]
        if x == y:
            n = stretch(a_ends, b_ends, i, j)
            moves += BOTH_END * n
            i += n
            j += n
        elif x < y:
            moves += A_ENDS
            i += 1
        else:
            moves += B_ENDS
            j += 1
    return moves


def listed(
    tokens: Tokenized, a_stops: np.ndarray, b_stops: np.ndarray, decimals: np.ndarray
) -> str:
    """Ids of groups that end before ``a_stops`` and ``b_stops``, as ``a1,a2|b1;a3|b2,b3``."""
    a_sizes, b_sizes = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
    a_starts, b_starts = a_stops - a_sizes, b_stops - b_sizes
    ids = np.empty(len(tokens.a) + len(tokens.b), dtype=np.int32)
    ids[np.arange(len(tokens.a)) + np.repeat(b_starts, a_sizes)] = tokens.a
    ids[np.arange(len(tokens.b)) + np.repeat(a_stops, b_sizes)] = tokens.b
    # A row is what stands before an id, the id's digits, and zeros that are left out.
    width = decimals.itemsize
    shown = np.empty((len(ids), 1 + width), dtype=np.uint8)
    shown[:, 0] = ord(",")
    shown[a_starts + b_starts, 0] = ord(";")
    shown[a_stops + b_starts, 0] = ord("|")
    shown[:, 1:] = decimals[ids].view(np.uint8).reshape(-1, width)
    return shown[shown != 0][1:].tobytes().decode()


def align(
    tokens: Tokenized,
    a_ends: list[int],
    b_ends: list[int],
    decimals: np.ndarray | Sequence[str],
) -> Aligned:
    """Groups between common ends, and all overlapping tokens. Both end at the same offset."""
    moves = np.frombuffer(walk(a_ends, b_ends), np.uint8)
    a_moves, b_moves = moves & A_ENDS[0] != 0, moves & B_ENDS[0] != 0
    a_stops, b_stops = np.cumsum(a_moves), np.cumsum(b_moves)
    pairs = tokens.a[a_stops - a_moves] * np.int64(BASE) + tokens.b[b_stops - b_moves]
    both = a_moves & b_moves
    a_stops, b_stops = a_stops[both], b_stops[both]
    groups = listed(tokens, a_stops, b_stops, np.asarray(decimals, dtype="S"))
    return Aligned(groups, len(a_stops), pairs)


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from zero on, compressed; a byte tells the size of each, the least for the largest."""
    small = numbers.astype(np.min_scalar_type(numbers.max(initial=0)))
    return bytes([small.itemsize]) + pa.compress(small.tobytes(), codec="zstd", asbytes=True)


def widened(raw: bytes, many: int) -> np.ndarray:
    """The ``many`` numbers that ``narrow`` was given."""
    size = raw[0]
    whole = pa.decompress(raw[1:], decompressed_size=size * many, codec="zstd", asbytes=True)
    return np.frombuffer(whole, f"u{size}").astype(np.int64)


class _Block:
    """Documents whose links are counted together; one row of the table of blocks."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[tuple[int, int, int, int]] = []
        self.groups: list[str] = []
        # Of each document, its different pairs and the number of links of each.
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n_links = 0

    def add(self, doc_id: int | None, tokens: Tokenized | None, aligned: Aligned | None) -> None:
        self.ids.append(doc_id)
        self.groups.append(aligned.groups if aligned else "")
        own = aligned.pairs if aligned else np.empty(0, dtype=np.int64)
        n_groups = aligned.n_groups if aligned else 0
        a, b = tokens or ((), ())
        self.counts.append((len(a), len(b), n_groups, len(own)))
        pairs, times = np.unique(own, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times.astype(np.int32))
        self.n_links += len(own)

    def row(self, name: int) -> pa.RecordBatch:
        """``pairs`` are the block's different id pairs and ``many`` their links; each document
        has its different pairs as ``places`` in ``pairs``, with the number of its links. Those
        two are most of a row, and narrow: executors hold many rows at once."""
        sizes = _sizes(self.pairs)
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.concatenate(self.times)
        many = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(many, places, times)
        n_a, n_b, n_groups, n_links = zip(*self.counts)
        columns = [
            (pa.int64(), self.ids),
            (pa.string(), self.groups),
            (pa.int64(), n_a),
            (pa.int64(), n_b),
            (pa.int64(), n_groups),
            (pa.int64(), n_links),
            (pa.int32(), sizes),
            (pa.int64(), pairs),
            (pa.int64(), many),
        ]
        arrays = [pa.ListArray.from_arrays([0, len(c)], pa.array(c).cast(t)) for t, c in columns]
        packed = [pa.array([narrow(x)], pa.binary()) for x in (places, times)]
        return pa.record_batch([pa.array([name], pa.int64()), *arrays, *packed], names=_NAMES)


_BLOCKS = (
    "block long, ids array<long>, groups array<string>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, sizes array<int>, pairs array<long>, "
    "many array<long>, places binary, times binary"
)
_NAMES = [f.split(" ")[0] for f in _BLOCKS.split(", ")]


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose documents, but for the last, have less than ``SLICE_BYTES`` of text."""
    for batch in slices(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        starts = [0, *(np.flatnonzero(np.diff(before // SLICE_BYTES)) + 1).tolist()]
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, stop - start)


def _blocks(docs: DataFrame, files: tuple[str, str, str], digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files)
        task, many, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in _by_size(batches):
            found = pair.tokens(batch.column(1).to_pylist())
            for doc_id, tokens in zip(batch.column(0).to_pylist(), found):
                aligned = None
                if tokens:
                    ends = (
                        np.cumsum(t.lengths[x]).tolist()
                        for t, x in zip((pair.first, pair.second), tokens)
                    )
                    aligned = align(tokens, *ends, pair.decimals)
                    if digest:
                        name = sha256(aligned.groups.encode()).hexdigest()
                        aligned = aligned._replace(groups=name)
                block.add(doc_id, tokens, aligned)
                if block.n_links >= BLOCK_LINKS or len(block.ids) >= BLOCK_DOCS:
                    yield block.row(task << 32 | many)
                    many, block = many + 1, _Block()
        # The worker stays, and what it does next has no use for the memo.
        pair.forget()
        if block.ids:
            yield block.row(task << 32 | many)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut_lineage(texts.mapInArrow(run, _BLOCKS))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each id pair in the corpus; ``best`` if no other pair with
    the same second id has more."""
    own = blocks.select(F.explode(F.arrays_zip("pairs", "many")).alias("p"))
    counts = own.groupBy("p.pairs").agg(F.sum("p.many").alias("count"))
    second = Window.partitionBy(F.pmod("pairs", F.lit(BASE)))
    best = F.col("count") == F.max("count").over(second)
    return cut_lineage(counts.select(F.col("pairs").alias("pair"), "count", best.alias("best")))


def align_tokens(
    docs: DataFrame, first: str, pattern: str, second: str, digest: bool = False
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, a row a document.

    A blank and the text is tokenised by ``first`` (byte-level BPE, its words cut by ``pattern``),
    the text by ``second`` (sentencepiece, which adds the blank). Offsets where tokens of both end
    cut them into groups, listed as decimal ids ``a1,a2|b1;a3|b2,b3``; with ``digest`` their
    SHA-256 in hex takes their place. Tokens that overlap are linked. ``count_sum`` sums, over the
    document's links, how many links of the corpus hold the same id pair; ``n_best`` counts links
    whose pair is a most frequent one of its second id. Texts that are null, empty or not given
    back by ``second`` have no tokens: zeros and an empty string. Repeated rows and null ids are
    rows like others; other columns are not read.
    """
    blocks = _blocks(docs, (first, pattern, second), digest)
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    of_pair = F.struct("at", "count", F.col("best").cast("int").alias("best"))
    known = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(of_pair).alias("known"))
    packed = ["places", "times"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            one = {n: row.column(n).flatten() for n in row.schema.names if n not in packed}
            doc = np.repeat(np.arange(len(one["ids"])), np.asarray(one["sizes"]))
            places, times = (widened(row.column(n)[0].as_py(), len(doc)) for n in packed)
            at, *of_pairs = map(np.asarray, one["known"].flatten())

            def summed(of_pair: np.ndarray) -> pa.Array:
                in_place = np.zeros(len(at), dtype=np.int64)
                in_place[at] = of_pair
                out = np.zeros(len(one["ids"]), dtype=np.int64)
                np.add.at(out, doc, in_place[places] * times)
                return pa.array(out, pa.int64())

            count, best = map(summed, of_pairs)

            yield pa.record_batch(
                [
                    one["ids"],
                    *(one[n] for n in ("n_a", "n_b", "n_groups", "n_links")),
                    best,
                    count,
                    one["groups"],
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )

    columns = ["ids", "groups", "n_a", "n_b", "n_groups", "n_links", "sizes", *packed]
    beside = blocks.select("block", *columns).join(known, "block", "left")
    return beside.select(*columns, "known").mapInArrow(
        sums,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups string",
    )
