"""The pipeline's stages against plain Python on a small table."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seasoncast.llm.pii import base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("th", "er", "on", "re", "an") for b in ("in", "ed", "ly", "ou", "st", "ha")]
    prose = lambda n: " ".join(draw.choices(words, k=n)).capitalize() + "."
    texts = [prose(draw.randint(40, 120)) for _ in range(60)]
    texts += ["BUY$$$ NOW!! " * draw.randint(10, 40) for _ in range(40)]
    texts += [texts[0], texts[0] + " More.", texts[1]]
    texts += [prose(50) + f" Write to a{i}.b@mail{i}.example.com or 10.0.0.{i} today." for i in range(20)]
    texts += [prose(6000)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(500, prose(60), None, None, None), (None, prose(60), "en", "src0", 1), rows[5], (501, None, "en", "src1", None), (502, "", "en", "src1", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("$$$" not in t), 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_dedup", "pii", "packing"]

    good = steps["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = [tuple(r) for r in good.collect()]
    plain = [r for r in given if r[1] and "$$$" not in r[1]]
    assert sorted(map(repr, plain)) == sorted(repr(r) for r in kept if r[1])
    assert set(kept) <= set(given)

    single = steps["near_dedup"](spark, good, sf_dir)
    assert single.columns == docs.columns
    ids = [r["doc_id"] for r in single.collect()]
    gone = {100, 101, 102}
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in kept if r[0] is not None} - gone)
    assert ids.count(None) == 1

    clean = steps["pii"](spark, single, sf_dir)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    for row in clean.collect():
        if row["text"]:
            assert base_spans(row["text"]) == [] and row["n_chars"] == len(row["text"])

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = []
    for row in clean.collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((row["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    packed = [tuple(r) for r in steps["packing"](spark, clean, sf_dir).collect()]
    assert sorted(map(repr, (r[:5] for r in packed))) == sorted(map(repr, want))
    whole = sorted(map(repr, packed))
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(whole) == len(again)
    assert sorted(repr(tuple(r)[:5]) for r in again) == sorted(map(repr, want))


def test_no_documents(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
