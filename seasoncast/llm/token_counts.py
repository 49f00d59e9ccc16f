"""Greedy longest-match token counts in time linear in the text, without building pieces.

The automaton is the vocabulary's trie with failure links. Where the next byte has no edge, the
longest match so far is final: the node knows how many tokens that pops, and its failure link is
the node of what remains after them. So every byte is read once and nothing is matched again.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seasoncast.llm.memo import Memo
from seasoncast.llm.word_bpe import chunks, load_word_bpe

_NONE = -1


class LongestMatch:
    """``count(word)``: tokens of the greedy longest match, or -1 where a rest has no match.

    ``starts`` are the strings that may begin a word, ``rests`` those that may follow (the same,
    if not given; vocabularies that mark continuations have other ones).
    """

    def __init__(self, starts: Iterable[bytes], rests: Iterable[bytes] | None = None):
        self._edges: dict[int, int] = {}  # node * 256 + byte
        self._fail, self._popped, ends = [_NONE], [0], [False]
        self._root = self._grow(0, starts, ends)
        self._rest = self._root
        if rests is not None:
            self._rest = len(ends)
            ends.append(False)
            self._fail.append(_NONE)
            self._popped.append(0)
            self._grow(self._rest, rests, ends)
        self._link(ends)

    def _grow(self, root: int, words: Iterable[bytes], ends: list[bool]) -> int:
        for word in words:
            at = root
            for byte in word:
                key = at * 256 + byte
                if key not in self._edges:
                    self._edges[key] = len(ends)
                    ends.append(False)
                    self._fail.append(_NONE)
                    self._popped.append(0)
                at = self._edges[key]
            ends[at] = ends[at] or bool(word)
        return root

    def _link(self, ends: list[bool]) -> None:
        """Links of shorter strings first."""
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self._edges.items():
            below.setdefault(key // 256, []).append((key % 256, to))
        level = sorted({self._root, self._rest})
        while level:
            deeper = []
            for at in level:
                for byte, to in below.get(at, ()):
                    deeper.append(to)
                    if ends[to]:
                        self._fail[to], self._popped[to] = self._rest, 1
                        continue
                    popped, link = self._popped[at], self._fail[at]
                    while link != _NONE and link * 256 + byte not in self._edges:
                        popped += self._popped[link]
                        link = self._fail[link]
                    if link != _NONE:
                        self._fail[to], self._popped[to] = self._edges[link * 256 + byte], popped
            level = deeper

    def count(self, word: bytes) -> int:
        edges, fail, popped = self._edges, self._fail, self._popped
        at, n = self._root, 0
        for byte in word:
            while (to := edges.get(at * 256 + byte)) is None:
                n += popped[at]
                at = fail[at]
                if at == _NONE:
                    return _NONE
            at = to
        while at not in (self._root, self._rest):
            n += popped[at]
            at = fail[at]
            if at == _NONE:
                return _NONE
        return n


class TextCounter:
    """Counts of whole texts, with a memo for what stands between two blanks."""

    def __init__(self, vocab: str):
        self._bpe = load_word_bpe(vocab)
        self._match = LongestMatch(self._bpe.strings)
        self._memo = Memo(self._chunk, limit=500_000)

    def _chunk(self, chunk: str) -> tuple[int, int, int, int]:
        words = [w.encode() for w in self._bpe.words(chunk)]
        found = [self._match.count(w) for w in words]
        unknown = found.count(_NONE)
        known = [n for n in found if n != _NONE]
        return len(words), sum(known) + unknown, unknown, max(known, default=0)

    def count(self, text: str | None) -> tuple[int, int, int, int]:
        words = tokens = unknown = longest = 0
        for w, t, u, m in self._memo.all(chunks(text)):
            words += w
            tokens += t
            unknown += u
            longest = m if m > longest else longest
        return words, tokens, unknown, longest


@lru_cache(maxsize=1)
def _counter(vocab: str) -> TextCounter:
    return TextCounter(vocab)


def count_tokens(text: Column, vocab: str) -> Column:
    """``struct<n_words, n_tokens, n_unknown, longest_word>``.

    Text is normalised and split into words as the vocabulary file says; a word is then matched
    against the file's strings (word-end marks removed), longest first. A word with a rest that
    has no match is one unknown token. ``longest_word`` is the most tokens of one word. Null and
    empty texts count zero.
    """
    names = ["n_words", "n_tokens", "n_unknown", "longest_word"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def counts(texts: pa.Array) -> pa.Array:
        counter = _counter(vocab)
        rows = [counter.count(t.as_py()) for t in texts]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return counts(text)
