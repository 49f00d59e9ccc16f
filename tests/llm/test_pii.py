"""Patterns against plain regular expressions, the tagger's gradients and its held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasoncast.llm import pii
from seasoncast.llm.span_tagger import CLASSES, Tagger

# The patterns as given.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            found, digits = m.group(), re.sub("[^0-9]", "", m.group())
            good = (
                True,
                all(int(p) <= 255 for p in found.split(".")) if kind == 1 else True,
                13 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_patterns():
    draw = random.Random(2)
    for alphabet, n in (("ab1.@-+ 2", 4000), ("0123456789 -.+()", 4000)):
        for _ in range(n):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
            assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("9" * 200_000 + "a@" * 50_000) == []


def test_gradients():
    tagger = Tagger.new(9, embed=3, hidden=4)
    draw = np.random.default_rng(0)
    x, y = draw.integers(0, CLASSES, (3, 7)), draw.integers(0, 9, (3, 7))
    _, slopes = tagger.loss(x, y)
    for name, w in tagger.weights.items():
        at = (x[0, 0], 1) if name == "embed" else tuple(s // 2 for s in w.shape)
        old, values = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            values.append(tagger.loss(x, y)[0])
        w[at] = old
        assert abs((values[0] - values[1]) / 2e-5 - slopes[name][at]) < 1e-6


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.train(docs.filter("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, tagger):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1")
    texts = [r["text"] for r in docs.select("text").collect()]
    own = pii.tagged_spans(texts, tagger)
    want = [pii.base_spans(t) for t in texts]
    right = sum(len(set(a) & set(b)) for a, b in zip(own, want))
    assert right >= 0.95 * sum(map(len, want)) and sum(map(len, want)) > 200
    assert right >= 0.95 * sum(map(len, own))


def test_windows_agree_over_long_texts(tagger):
    texts = ["word " * k + "mail bosbt.42@mail8.example.com now " + "word " * 40 for k in range(40)]
    for text, own in zip(texts, pii.tagged_spans(texts, tagger)):
        assert own == pii.base_spans(text)


def test_columns(spark, tagger):
    texts = [
        None,
        "",
        "no data here",
        "x@y.zz x@y.zz",
        "word " * 60_000 + "mail x@y.zz, 10.0.0.1 and +1 (988) 555-2485",
    ]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "i int, text string, spans string")
    for model in (tagger, None):
        rows = docs.select("i", pii.find_pii(F.col("text"), model).alias("f")).orderBy("i").collect()
        for row, text in zip(rows, texts):
            base = [(pii.KINDS.index(s["kind"]), s["start"], s["stop"]) for s in row["f"]["base"]]
            assert base == sorted(plain(text or ""))
            assert set(map(tuple, row["f"]["base"])) <= set(map(tuple, row["f"]["spans"]))
        clean = docs.select("i", pii.redact(F.col("text"), model).alias("r")).orderBy("i").collect()
        assert [r["r"] for r in clean[:4]] == [None, "", "no data here", "<EMAIL> <EMAIL>"]
        assert clean[4]["r"].endswith("mail <EMAIL>, <IP> and <PHONE>")


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert pii.train(none) is None
    assert pii.train(spark.createDataFrame([(1, "no data 3")], "doc_id int, text string")) is None
