"""Reply trees as training conversations: paths by self-joins, ranked branches, a marked-up text.

Built-in functions only. Ancestors come from pointer doubling: after k joins of the table with
itself a node knows its ancestor 2^k steps up, so a tree of depth d takes about log2(d) joins. The
chosen branches are then unrolled with the same tables, each step once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.sources.shared import cut_lineage


@dataclass(frozen=True)
class Template:
    """``start role newline text end`` for each turn; ``learned`` roles are under the loss mask.

    In texts, a backslash goes after the first character of every control string, and one more
    where backslashes stand there already: nothing in a text reads as a control string, and
    taking one backslash away gives the text back. Roles are URL-encoded.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("a control string must not hold the start of another, or a backslash")
        if self.start not in self.controls:
            raise ValueError("the start of a turn must be a control string")

    def _pattern(self, slashes: str) -> str:
        """The first character of a control string that has ``slashes`` after it."""
        rests: dict[str, list[str]] = {}
        for control in self.controls:
            rests.setdefault(control[0], []).append(re.escape(control[1:]))
        return "|".join(
            rf"{re.escape(head)}(?={slashes}(?:{'|'.join(rest)}))" for head, rest in rests.items()
        )

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"({self._pattern(r'\\*')})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"({self._pattern(r'\\+')})\\", "$1")

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), F.url_encode(role), F.lit("\n"))


def thread_messages(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Conversations by turn as trees without branches, in the columns of ``format_branches``.

    Equal turns are taken in the order of role and text, null turns come first.
    """
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    numbered = rows.select(
        F.col(conv).alias("tree"),
        F.row_number().over(order).cast("long").alias("node"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.withColumns({"parent": parent, "score": F.lit(0.0)})


def _ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps, and what is known of each node that has a root.

    Table k of the first holds ``tree, node, up``, the ancestor 2^k steps up, for the nodes that
    have one. The second has ``steps``, the nodes from the root on, and ``total``, the sum of their
    scores. A node leaves the joins once it has met its root; only nodes under a cycle never do.
    """
    keys = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    joined = nodes.join(
        keys, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left"
    )
    rows = cut_lineage(
        joined.select(
            "tree",
            "node",
            F.col("_n").alias("up"),
            F.lit(1).cast("long").alias("steps"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
        )
    )
    jumps, met, waiting = [], rows.filter("up IS NULL"), None
    while True:
        open_rows = rows.filter("up IS NOT NULL")
        many = open_rows.count()
        # Without a cycle, fewer nodes have an ancestor at twice the distance.
        if many == 0 or many == waiting:
            return jumps, met.drop("up")
        jumps.append(open_rows.select("tree", "node", "up"))
        above = met.unionByName(open_rows).select(
            F.col("tree").alias("_t"),
            F.col("node").alias("_n"),
            F.col("up").alias("_up"),
            F.col("steps").alias("_steps"),
            F.col("total").alias("_total"),
        )
        rows = cut_lineage(
            open_rows.join(
                above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n"))
            ).select(
                "tree",
                "node",
                F.col("_up").alias("up"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
                (F.col("total") + F.col("_total")).alias("total"),
            )
        )
        met, waiting = met.unionByName(rows.filter("up IS NULL")), many


def branch_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each tree.

    ``nodes`` has ``tree, node, parent, score``. Columns: ``tree, leaf, branch`` (rank from 1),
    ``branch_score`` (sum over the path, null scores count 0), ``node``, ``turn`` (from 0 at the
    root). More score, then the longer path, then the smaller leaf comes first. A parent that the
    tree does not have makes a root; nodes on or under a cycle have no root and are on no path.
    """
    jumps, top = _ancestors(nodes)
    parents = nodes.select(F.col("tree").alias("_t"), F.col("parent").alias("_n"))
    rank = F.row_number().over(
        Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "node")
    )
    leaves = (
        top.join(
            parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "anti"
        )
        .withColumn("branch", rank)
        .filter(F.col("branch") <= branches)
    )
    paths = cut_lineage(
        leaves.select(
            "tree",
            F.col("node").alias("leaf"),
            "branch",
            F.col("total").alias("branch_score"),
            "node",
            (F.col("steps") - 1).alias("turn"),
        )
    )
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        further = paths.join(
            jump, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
        ).select(
            "tree",
            "leaf",
            "branch",
            "branch_score",
            F.col("up").alias("node"),
            (F.col("turn") - (1 << k)).alias("turn"),
        )
        paths = cut_lineage(paths.unionByName(further))
    return paths


def format_branches(
    messages: DataFrame, template: Template = Template(), branches: int = 1
) -> DataFrame:
    """One conversation for each chosen path: ``tree, leaf, branch, branch_score, formatted, mask``.

    ``messages`` has ``tree, node, parent, role, text, score``; ``node`` is unique in its tree
    (of repeated nodes, the one with the smallest parent, role and text counts). ``mask`` lists
    the spans under the loss, in code points of ``formatted``, as ``turn, start, stop``. Null
    roles and texts are empty, a null tree is a tree like others, other columns are not read.
    """
    unique = messages.groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")
    )
    nodes = cut_lineage(unique.select("tree", "node", "m.*"))
    paths = branch_paths(nodes.select("tree", "node", "parent", "score"), branches)
    said = nodes.select(
        F.col("tree").alias("_t"),
        F.col("node").alias("_n"),
        F.coalesce("role", F.lit("")).alias("role"),
        template.escape(F.coalesce("text", F.lit(""))).alias("said"),
    )
    turns = paths.join(
        said, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
    ).withColumn("head", template.head(F.col("role")))
    whole = F.concat("head", "said", F.lit(template.end))
    before = F.sum(F.length("whole")).over(
        Window.partitionBy("tree", "leaf")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.length("whole")
    start = F.col("before") + F.length("head")
    span = F.struct(
        F.col("turn").alias("turn"), start.alias("start"), (start + F.length("said")).alias("stop")
    )
    placed = turns.withColumn("whole", whole).withColumn("before", before)
    return placed.groupBy("tree", "leaf", "branch", "branch_score").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", "whole"))), lambda x: x["whole"]
            ),
            "",
        ).alias("formatted"),
        F.array_sort(
            F.collect_list(F.when(F.col("role").isin(*template.learned), span))
        ).alias("mask"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns of formatted conversations: ``tree, leaf, turn, role, text, learned``.

    ``learned`` is the unescaped text under the mask in that turn, null where there is none.
    """
    parts = formatted.select(
        "tree",
        "leaf",
        F.posexplode(F.split("formatted", re.escape(template.start))).alias("_at", "part"),
    ).filter("_at > 0")
    lead = len(template.start)
    start = F.sum(F.length("part") + lead).over(
        Window.partitionBy("tree", "leaf")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.length("part")
    turns = parts.withColumns({"_start": start, "turn": (F.col("_at") - 1).cast("long")})
    spans = formatted.select(
        F.col("tree").alias("_t"), F.col("leaf").alias("_l"), F.explode("mask").alias("_span")
    )
    met = turns.join(
        spans,
        F.col("tree").eqNullSafe(F.col("_t"))
        & (F.col("leaf") == F.col("_l"))
        & (F.col("turn") == F.col("_span.turn")),
        "left",
    )
    head = F.substring_index("part", "\n", 1)
    body = F.substring(
        F.col("part"),
        F.length(head) + 2,
        F.length("part") - F.length(head) - 1 - len(template.end),
    )
    under = F.substring(
        F.col("part"),
        (F.col("_span.start") - F.col("_start") + 1).cast("int"),
        (F.col("_span.stop") - F.col("_span.start")).cast("int"),
    )
    return met.select(
        "tree",
        "leaf",
        "turn",
        F.url_decode(head).alias("role"),
        template.unescape(body).alias("text"),
        template.unescape(under).alias("learned"),
    )
