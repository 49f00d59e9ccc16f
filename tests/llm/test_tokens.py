"""Token counts, word-end and byte-level BPE against brute force and the public libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasoncast.llm import byte_bpe
from seasoncast.llm.memo import Memo
from seasoncast.llm.pieces import token_pieces
from seasoncast.llm.token_counts import LongestMatch, count_tokens
from seasoncast.llm.word_bpe import WordBpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None,
    "",
    "   ",
    "Don't we'LL  \n x",
    "ΣΑΣ İstanbul ﬁ ①²3 \u0301a \x1c\x1d a\x85b",
    "日本 語　x \u200b ١٢ ½³",
    "é é  🙂👍🏽 <|endoftext|> <|startoftext|>a",
    "a\n\n b \t\ty ",
    "x" * 3000 + " " * 300 + "!" * 300,
    "ab" * 2000,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return ODD + [r["text"] for r in rows]


@pytest.fixture(scope="module")
def prefix_bpe():
    return byte_bpe.PrefixBpe.read(RANKS, public_tokenizers.PATTERN)


def test_memo_forgets_but_stays_right():
    memo = Memo(len, limit=3, longest=4)
    assert [memo[k] for k in ("a", "bb", "ccc", "dddd", "eeeee", "a")] == [1, 2, 3, 4, 5, 1]
    assert len(memo) <= 3 and "eeeee" not in memo


def test_word_bpe_equals_library(texts):
    library = Tokenizer.from_file(WORD_BPE)
    library.encode_special_tokens = True
    own = WordBpe(WORD_BPE)
    for text in texts:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want


def greedy(word, starts, rests):
    n = at = 0
    while at < len(word):
        known = starts if at == 0 else rests
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_longest_match_equals_greedy():
    draw = random.Random(3)
    some = lambda low, high: bytes(draw.choice(b"abc") for _ in range(draw.randint(low, high)))
    for round_ in range(60):
        starts = {some(1, 5) for _ in range(12)}
        rests = {some(1, 5) for _ in range(12)} if round_ % 2 else None
        own = LongestMatch(starts, rests)
        for _ in range(100):
            word = some(0, 14)
            assert own.count(word) == greedy(word, starts, rests or starts)


def test_counts_in_spark(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "i int, text string")
    got = rows.select("i", count_tokens(F.col("text"), WORD_BPE).alias("n")).orderBy("i").collect()
    own = WordBpe(WORD_BPE)
    for row, text in zip(got, texts):
        words = [
            w.encode()
            for c in (text or "").replace("\n", " ").replace("\t", " ").split(" ")
            for w in own.words(c)
        ]
        assert row["n"]["n_words"] == len(words)
        assert row["n"]["n_tokens"] == sum(greedy(w, own.strings, own.strings) for w in words)
        assert row["n"]["n_unknown"] == 0
    assert rows.limit(0).select(count_tokens(F.col("text"), WORD_BPE)).count() == 0


def test_prefix_bpe_equals_library(texts, prefix_bpe):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    for text in texts:
        ids = np.frombuffer(prefix_bpe.encode(text), "<i4").tolist()
        assert ids == library.encode_ordinary(text or "")
        assert prefix_bpe.decode(ids) == (text or "").encode()


def test_appends_and_edits_are_exact(prefix_bpe):
    draw = random.Random(1)
    for _ in range(100):
        table = byte_bpe.PieceTable(prefix_bpe, bytes(draw.choice(b"abe thing") for _ in range(90)))
        table.append(b"ing")
        start = draw.randrange(60)
        new = bytes(draw.choice(b"abething") for _ in range(draw.randrange(6)))
        table.edit(start, start + draw.randrange(9), new)
        assert table.tokens() == prefix_bpe.merged(table.raw)
        assert b"".join(table.tokens()) == table.raw


def test_encode_in_spark_keeps_columns_and_replaces_the_named_one(spark, texts, prefix_bpe):
    rows = spark.createDataFrame(
        [(i, t, "old", None) for i, t in enumerate(texts[:30])],
        "doc_id int, text string, ids string, more string",
    )
    encoded = byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "more", "ids"]
    both = encoded.withColumn("raw", byte_bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN))
    for row in both.collect():
        assert bytes(row["raw"]).decode() == (texts[row["doc_id"]] or "")
    gone = byte_bpe.encode(rows.limit(0), RANKS, public_tokenizers.PATTERN, keep_text=False)
    assert gone.columns == ["doc_id", "more", "ids"] and gone.count() == 0


def test_pieces(spark):
    rows = [(1, None), (None, ""), (2, "word " * 5000), (2, "word " * 5000), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("length", F.lit("x"))
    got = token_pieces(docs, WORD_BPE).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], len(r["ids"])))
    assert by[1] == by[None] == [(0, 0, 1, 4)]
    assert by[3] == [(0, 0, 3, 12)]
    assert sorted(by[2]) == sorted(2 * [(0, 0, 2048, 8192), (1, 2048, 2048, 8192), (2, 4096, 905, 3620)])
    assert token_pieces(docs.limit(0), WORD_BPE).count() == 0
