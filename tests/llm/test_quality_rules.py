"""Quality rules against definitions written out in plain Python, and the divergence."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.llm import quality_rules
from seasoncast.llm.quality_rules import js_distance, judge, language_references, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def plain(text):
    """The base measures as the rules state them."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def texts():
    rng = random.Random(3)
    some = [None, "", " \n\t ", "one", "a b\na b\n\n \na b", "x y é　日本 🙂 #|<\x1c", "a " * 100]
    for _ in range(60):
        words = rng.choices(["a", "b", "ñ", "dd", "e."], k=rng.randint(0, 60))
        some.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\x0b"]) for w in words))
    return some


@pytest.mark.parametrize("text", texts())
def test_measures_equal_definitions(text):
    assert measure(text.encode() if text is not None else None)[:6] == plain(text)


def test_histograms_hold_all_characters_and_words():
    one = measure("The THE the. Ñandú 42 #\n".encode())
    assert one.classes.tolist() == [8, 4, 2, 6, 1, 1, 2]
    assert one.words == {b"the": 2, b"the.": 1, "Ñandú".encode(): 1, b"42": 1, b"#": 1}


def test_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert js_distance(p, q) == 1.0 and js_distance(p, 5 * p) == 0.0
    half = js_distance(np.array([1.0, 1.0]), np.array([1.0, 0.0]))
    direct = 0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25) + math.log2(1 / 0.75)
    assert half == pytest.approx(math.sqrt(direct / 2))


def prose(rng, n):
    """Words of a made-up language: half are its common ones."""
    common = ["the", "of", "and", "to", "in"]
    own = [
        rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeiounrst", k=7))
        for _ in range(n)
    ]
    return " ".join(own) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(100, 200)), "en") for i in range(40)]
    shouted = prose(rng, 120).upper()
    signs = " ".join(w + "***" for w in prose(rng, 120).split())
    rare = " ".join("".join(rng.choices("aeiounrst", k=7)) for _ in range(120))
    rows += [
        (100, shouted, "en"),
        (101, signs, "en"),
        (102, rare, "en"),
        (103, " ".join(rare.split()[:79]), "en"),  # too short for its words to be compared
        (104, rare, "xx"),  # too little text for a reference
        (105, rare, None),
        (106, "Und " * 500, "en"),
        (107, None, "en"),
        (108, "", None),
        (None, rows[0][1], "en"),
        (0, rows[0][1], "en"),
        (109, "a" * 200_000 + " the" * 30, "en"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_verdicts(docs):
    wide = docs.withColumns({"n_words": F.lit("x"), "kept": F.lit(0), "common": F.lit(1)})
    rows = judge(wide).collect()
    assert len(rows) == docs.count()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i in range(40)) and kept[None]
    assert not any(kept[i] for i in (100, 101, 102, 106, 107, 108))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[103]["word_distance"] is None and by_id[103]["kept"]
    assert by_id[104]["class_distance"] is None and by_id[104]["kept"] and by_id[105]["kept"]
    assert sum(r["doc_id"] == 0 for r in rows) == 2
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert (*own, r["base_failed"]) == measure((text[r["doc_id"]] or "").encode())[:6]


def test_references_pool_what_passes(docs):
    references = {r["lang"]: r for r in language_references(docs).collect()}
    assert set(references) == {"en"}
    passing = [
        measure(r["text"].encode())
        for r in docs.filter("lang = 'en' AND text IS NOT NULL").collect()
        if not measure(r["text"].encode()).base_failed
    ]
    one = references["en"]
    assert one["class_counts"] == sum(p.classes for p in passing).tolist()
    assert one["n_words"] == sum(p.n_words for p in passing) == sum(one["word_counts"])
    assert [w.decode() for w in one["common"][:5]] and len(one["common"]) == quality_rules.COMMON
    assert one["word_counts"][0] == sum(p.words[bytes(one["common"][0])] for p in passing)


def test_many_languages_meet_by_salt(docs, monkeypatch):
    few = sorted(map(str, judge(docs).collect()))
    monkeypatch.setattr(quality_rules, "FEW_LANGUAGES", 0)
    assert sorted(map(str, judge(docs).collect())) == few


def test_counts_passed_on_early_are_the_same(docs, monkeypatch):
    want = language_references(docs).collect()
    monkeypatch.setattr(quality_rules, "COUNTED", 10)
    assert language_references(docs).collect() == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert judge(empty).count() == 0
