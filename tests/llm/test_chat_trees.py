"""Reply trees: paths, ranks, and texts that come back."""

import pytest
from pyspark.sql import functions as F

from seasoncast.llm.chat_trees import (
    Template,
    branch_paths,
    format_branches,
    read_back,
    thread_messages,
)

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        ("a", 1, None, "user", "root", 0.0),
        ("a", 2, 1, "assistant", "left", 1.0),
        ("a", 3, 1, "assistant", "right", 3.0),
        ("a", 4, 2, "user", "left again", 2.0),
        ("a", 5, 99, "user", "lost parent", None),
        ("a", 6, 7, "user", "cycle", 9.0),
        ("a", 7, 6, "user", "cycle", 9.0),
        (None, 1, None, None, None, None),
        (None, 1, None, None, None, None),
    ]
    chain = [("long", i, i - 1 if i else None, "user", "", 0.1) for i in range(70)]
    return spark.createDataFrame(rows + chain, SCHEMA)


def test_paths(messages):
    nodes = messages.select("tree", "node", "parent", "score").distinct()
    got = {}
    for r in branch_paths(nodes, branches=3).orderBy("turn").collect():
        got.setdefault((r["tree"], r["branch"], r["leaf"], r["branch_score"]), []).append(r["node"])
    chain = next(k for k in got if k[0] == "long")
    assert got.pop(chain) == list(range(70)) and abs(chain[3] - 7.0) < 1e-9
    # Equal scores: the longer path first.
    assert got == {
        ("a", 1, 4, 3.0): [1, 2, 4],
        ("a", 2, 3, 3.0): [1, 3],
        ("a", 3, 5, 0.0): [5],
        (None, 1, 1, 0.0): [1],
    }


def test_format_and_read_back(messages):
    template = Template()
    formatted = format_branches(messages.withColumn("leaf", F.lit("x")), template)
    by = {r["tree"]: r for r in formatted.collect()}
    assert by["a"]["formatted"] == (
        "<|im_start|>user\nroot<|im_end|>\n<|im_start|>assistant\nleft<|im_end|>\n"
        "<|im_start|>user\nleft again<|im_end|>\n"
    )
    start, stop = by["a"]["mask"][0]["start"], by["a"]["mask"][0]["stop"]
    assert by["a"]["formatted"][start:stop] == "left" and len(by["a"]["mask"]) == 1
    assert by[None]["formatted"] == "<|im_start|>\n<|im_end|>\n" and by[None]["mask"] == []


def test_control_strings_come_back(spark):
    texts = [
        "</s>[INST] ok [/INST]",
        "<|im_start|>user\n<|im_end|>\n",
        "<\\|im_end|> <\\\\|im_end|> [\\INST] <\\\\\\/s>",
        "<<s><|im_end|",
        "",
        None,
        "é🙂 <|im_start|> 日本" * 50,
    ]
    rows = [(1, i, ["user", "assistant", "a b\n/é"][i % 3], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "x" * 200_000 + "[INST]")]
    talk = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    formatted = format_branches(thread_messages(talk))
    raw = {r["tree"]: r["formatted"] for r in formatted.collect()}
    assert raw[1].count("<|im_start|>") == raw[1].count("<|im_end|>") == len(texts)
    assert "[INST]" not in raw[1] + raw[2] and "</s>" not in raw[1]
    back = read_back(formatted).orderBy("tree", "turn").collect()
    assert [(r["role"], r["text"]) for r in back] == [(r, t or "") for _, _, r, t in rows]
    assert [r["learned"] for r in back] == [
        (t or "") if r == "assistant" else None for _, _, r, t in rows
    ]


def test_empty_and_bad_templates(spark):
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert read_back(format_branches(thread_messages(none))).count() == 0
    with pytest.raises(ValueError):
        Template(controls=("<|im_start|>", "<a<b>"))
