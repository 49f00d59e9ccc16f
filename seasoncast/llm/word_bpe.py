"""Token ids of a lower-casing word-end BPE, exact and with a memo per word.

The file is one of the ``tokenizers`` library: NFC, white space runs to one space, lower case,
a split into words, then merges in which the last byte of a word carries ``</w>``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
import tiktoken

from seasoncast.llm.memo import Memo

# Never part of UTF-8; stands for the end of a word.
_END = b"\xff"


def _byte_of_char() -> dict[str, int]:
    """The usual printable stand-ins for the 256 bytes, as a rule: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(text: str | None) -> list[str]:
    """Parts between the blanks that every library counts as white space; other white space stays
    within a part and is left to the word pattern."""
    return (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class WordBpe:
    """Ids of the library's ``encode(text, add_special_tokens=False)``, special strings being text.

    A chunk between blanks is tokenised alone: no normaliser, pattern or merge crosses a blank.
    Merges run in ``tiktoken`` over the same vocabulary. Merging by the rank of the joined bytes
    equals merging listed pairs, since each token has one merge and encodes to itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_of_char()

        def raw(token: str) -> bytes:
            word_end = token.endswith("</w>") and len(token) > 4
            body = token[:-4] if word_end else token
            return bytes(byte[c] for c in body) + (_END if word_end else b"")

        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        single = {chr_: b for chr_, b in byte.items()}
        order = [c + "</w>" for c in single] + [a + b for a, b in pairs] + list(single)
        ranks = {raw(t): i for i, t in enumerate(order)}
        ranks[_END] = len(order)
        self._bytes = [vocab[t].to_bytes(4, "little") for t in order] + [b""]
        split = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self._words = regex.compile(split)
        self.strings = {t.removesuffix(_END) for t in ranks} - {b""}
        self._core = tiktoken.Encoding(
            "word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )
        self._memo = Memo(self._chunk)

    def words(self, chunk: str) -> list[str]:
        """Words of one chunk without blanks, normalised."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else self._words.findall(chunk)

    def _chunk(self, chunk: str) -> bytes:
        piece, of = self._core._core_bpe.encode_single_piece, self._bytes.__getitem__
        return b"".join(
            b"".join(map(of, piece(word.encode() + _END))) for word in self.words(chunk)
        )

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Null counts as empty."""
        return b"".join(self._memo.all(chunks(text)))


@lru_cache(maxsize=2)
def load_word_bpe(path: str) -> WordBpe:
    """One tokenizer a worker process."""
    return WordBpe(path)
