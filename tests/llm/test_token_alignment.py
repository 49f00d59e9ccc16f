"""Alignment of two tokenizations against the libraries and all overlaps."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasoncast.llm import token_alignment
from seasoncast.llm.token_alignment import Tokenized, TokenizerPair, align, align_tokens, stretch

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
FILES = FIRST, public_tokenizers.PATTERN, SECOND
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "   \n", "a  b", "a ", "a \n  b\n \n", "\n  x", "x\t y  z 　 ", "x▁y", "<s> </s>",
    "<|endoftext|> don't we'LL", "日本 語　x 🙂👍🏽", "é é", "ﬁ ①²", "\x00a \x1c b", "1234 567", "ab" * 300,
    " " * 500 + "x" * 500, "a\x85  b \x1f  c", "<0x41> <unk>",
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def raw_first(first, i):
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in shown.values()]
    shown |= {chr(256 + n): b for n, b in enumerate(rest)}
    return bytes(shown[c] for c in first.id_to_token(i))


def raw_second(second, i):
    piece = second.id_to_piece(i)
    if second.is_byte(i):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends], ends))


def plain(libraries, text):
    """Ids of both, groups as text, and the linked id pairs by comparing all ranges."""
    first, second = libraries
    if not text:
        return [], [], "", []
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    raw_a, raw_b = [raw_first(first, i) for i in a], [raw_second(second, i) for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], "", []
    at_a, at_b = spans([*map(len, raw_a)]), spans([*map(len, raw_b)])
    common = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups = []
    for start, stop in zip([0, *common], common):
        inside = [
            ",".join(str(i) for i, (s, e) in zip(ids, at) if start <= s and e <= stop)
            for ids, at in ((a, at_a), (b, at_b))
        ]
        groups.append("|".join(inside))
    links = [
        (x, y) for x, (s, e) in zip(a, at_a) for y, (u, v) in zip(b, at_b) if max(s, u) < min(e, v)
    ]
    return a, b, ";".join(groups), links


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Ünder", "▁", "日", "'s", "9", "..", " ", "🙂"]
    mixed = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*ODD, *mixed, *(r["text"][:800] for r in rows[:40])])]


def test_tokens_equal_libraries(libraries, texts, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    pair = TokenizerPair(*FILES)
    first, second = libraries
    small = TokenizerPair(*FILES, limit=10, longest=5)
    given = [t for _, t in texts if t] + [r["text"] for r in rows]
    for text, own in zip(given, pair.tokens(given)):
        assert pair.first.encode(" " + text) == first.encode(" " + text, add_special_tokens=False).ids
        again = small.tokens([text])[0]
        if own is not None:
            assert own.a.tolist() == again.a.tolist() and own.b.tolist() == again.b.tolist()
            assert own.a.tolist() == first.encode(" " + text, add_special_tokens=False).ids
            assert own.b.tolist() == second.encode(text)
        else:
            raw = b"".join(raw_second(second, i) for i in second.encode(text))
            assert again is None and raw != (" " + text).encode()


def test_stretch_is_the_longest_common_run():
    rng = random.Random(2)
    for _ in range(500):
        a = np.cumsum(rng.choices([1, 2], k=rng.randint(1, 40))).tolist()
        b = a[: rng.randint(1, len(a))] + [a[-1] + 1] if rng.random() < 0.7 else a
        i = rng.randrange(min(len(a), len(b)))
        if a[i] != b[i]:
            continue
        n = 0
        while i + n < min(len(a), len(b)) and a[i + n] == b[i + n]:
            n += 1
        assert stretch(a, b, i, i) == n


def test_alignment_of_random_cuts():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(1, 60)
        cut = lambda: sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})
        a, b = cut(), cut()
        got = align(Tokenized(np.array(a), np.array(b)), a, b, list(map(str, range(61))))  # a token's id is its end
        links = [
            (x, y)
            for s, x in zip([0, *a], a)
            for u, y in zip([0, *b], b)
            if max(s, u) < min(x, y)
        ]
        assert [(p // token_alignment.BASE, p % token_alignment.BASE) for p in got.pairs.tolist()] == links
        assert got.n_groups == len(set(a) & set(b)) == got.groups.count(";") + 1
        assert len(links) == len(a) + len(b) - got.n_groups


@pytest.mark.parametrize("links,docs", [(1_000_000, 4096), (400, 5)])
def test_counts_equal_brute_force(spark, libraries, texts, monkeypatch, links, docs):
    monkeypatch.setattr(token_alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", docs)
    want = {i: plain(libraries, t) for i, t in texts}
    count = Counter(p for *_, own in want.values() for p in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    frame = spark.createDataFrame(texts, SCHEMA).repartition(3)
    rows = align_tokens(frame, *FILES).collect()
    hashed = {r["doc_id"]: r["groups"] for r in align_tokens(frame, *FILES, digest=True).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        a, b, groups, own = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["groups"], r["n_links"]) == (len(a), len(b), groups, len(own))
        assert r["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert r["n_best"] == sum(count[p] == most[p[1]] for p in own)
        assert r["count_sum"] == sum(count[p] for p in own)
        name = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert hashed[r["doc_id"]] == name


def test_cases(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "word " * 50_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n_a": F.lit("x"), "pairs": F.lit(0)})
    got = align_tokens(frame, *FILES).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["groups"] and r["doc_id"] in (None, 1)]
    assert len(same) == 3 and len({r["groups"] for r in same}) == 1
    assert all(r["count_sum"] == 6 and r["n_best"] == 2 for r in same)
    empty = [r for r in got if r["doc_id"] in (2, 3)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in empty)
    nothing = spark.createDataFrame([], SCHEMA)
    assert align_tokens(nothing, *FILES).count() == 0
    assert align_tokens(spark.createDataFrame(rows[3:5], SCHEMA), *FILES).count() == 2


@pytest.mark.parametrize("text", ["\xa0 \xa0", "x\xa0 \xa0\r  ", "\xa0 \xa0\n..", "a\xa0 \xa0 b"])
def test_white_space_joined_across_a_blank(libraries, text):
    own = TokenizerPair(*FILES).tokens([text])[0]
    assert own.a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_new_chunks_are_read_in_a_row_and_kept(monkeypatch):
    pair, read = TokenizerPair(*FILES), []
    encode = pair.first.encode
    monkeypatch.setattr(pair.first, "encode", lambda text: read.append(text) or encode(text))
    words = [f"w{i}é" for i in range(1000)]
    got = pair.tokens([" ".join(words), None, " ".join(reversed(words))])
    assert len(read) == 1 and got[1] is None
    assert got[0].a.tolist() == encode(" " + " ".join(words))
    assert pair.tokens([" ".join(words)])[0].b.tolist() == got[0].b.tolist() and len(read) == 1
    lost = TokenizerPair(*FILES)
    lost.second.bytes = [b"?" if b == b" the" else b for b in lost.second.bytes]
    own = lost.tokens(["a the b", "a b", "the"])
    assert own[0] is own[2] is None and own[1].a.tolist() == encode(" a b")


def test_long_and_wide_groups_against_plain(libraries):
    rng = random.Random(9)
    pair = TokenizerPair(*FILES)
    for _ in range(60):
        parts = rng.choices(["the ", "of", "日本", " 🙂", "xq", "1234", "é", "  "], k=rng.randint(1, 60))
        text = "".join(parts)
        a, b, groups, links = plain(libraries, text)
        own = pair.tokens([text])[0]
        if own is None:
            assert not links
            continue
        ends = (np.cumsum(t.lengths[x]).tolist() for t, x in zip((pair.first, pair.second), own))
        got = align(own, *ends, pair.decimals)
        assert (got.groups, got.n_groups) == (groups, groups.count(";") + 1)
        assert got.pairs.tolist() == [x * token_alignment.BASE + y for x, y in links]


def test_a_block_takes_little_memory():
    rng = np.random.default_rng(3)
    links = [rng.zipf(1.2, 1_400) % 10_000 for _ in range(700)] + [np.empty(0, np.int64)]
    block = token_alignment._Block()
    tracemalloc.start()
    for n, own in enumerate(links):
        ids = np.zeros(len(own), np.int32)
        block.add(n, Tokenized(ids, ids), token_alignment.Aligned("x" * 64, 1, own.copy()))
    batch = block.row(7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    row = batch.to_pydict()
    pairs, sizes = row["pairs"][0], row["sizes"][0]
    # Before, all links of the block were held at once, and an entry took two numbers of 32 bits.
    assert most < 32 << 20
    assert batch.nbytes < 4 * sum(sizes) + 16 * len(pairs) + 150 * len(links)
    places, times = (token_alignment.widened(row[n][0], sum(sizes)) for n in ("places", "times"))
    stops = np.cumsum(sizes)
    for own, start, stop in zip(links, stops - sizes, stops):
        got = {pairs[p]: n for p, n in zip(places[start:stop], times[start:stop])}
        assert got == Counter(own.tolist()) and len(got) == stop - start
    assert dict(zip(pairs, row["many"][0])) == Counter(np.concatenate(links).tolist())


@pytest.mark.parametrize("numbers", [[], [0], [255, 1], [256, 0], [1 << 16], [(1 << 31) - 1, 3]])
def test_narrow_numbers_come_back(numbers):
    raw = token_alignment.narrow(np.array(numbers, dtype=np.int64))
    assert token_alignment.widened(raw, len(numbers)).tolist() == numbers


def test_memo_is_bounded_in_bytes_and_forgotten():
    # Words of rare letters have many ids for few characters.
    rng = random.Random(6)
    texts = [" ".join("".join(chr(rng.randint(0xA000, 0xA400)) for _ in range(60)) for _ in range(40)) for _ in range(60)]
    pair, whole = TokenizerPair(*FILES, room=100_000), TokenizerPair(*FILES)
    for text in texts:
        own, want = pair.tokens([text])[0], whole.tokens([text])[0]
        assert own.a.tolist() == want.a.tolist() and own.b.tolist() == want.b.tolist()
        for kept in (pair._known, pair._older):
            assert sum(map(len, kept.values())) < 200_000
    pair.forget()
    assert not pair._known and not pair._older
    assert pair.tokens(texts[:1])[0].a.tolist() == whole.tokens(texts[:1])[0].a.tolist()


def test_long_texts_are_tokenised_few_at_once(monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 1_000)
    texts = ["a" * 600, None, "b" * 600, "", "c" * 5_000, "é" * 400, "d", None, *["e" * 90] * 400]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    cut = list(token_alignment._by_size(iter([batch, batch.slice(0, 0), batch.slice(2, 3)])))
    assert [r for b in cut for r in b["text"].to_pylist()] == texts + texts[2:5]
    assert [r for b in cut for r in b["doc_id"].to_pylist()] == [*range(len(texts)), 2, 3, 4]
    for b in cut:
        sizes = [len(t.encode()) for t in b["text"].to_pylist() if t]
        assert b.num_rows and sum(sizes[:-1]) < 1_000
