"""Regression trees for several targets at once, for many panels and cutoffs in one job.

All trees grow together. While a node has many rows, it is split level by level: weights and targets
of every such node are summed per feature and value, the best split of each is found from these
histograms, and the rows go on to the children. A histogram has one cell per category or bin, so no
large node is ever gathered. A node with few rows, which may be a whole tree, is finished with all
that is below it in one task. All nodes go to a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasoncast.operators.ranking import with_row_index
from seasoncast.sources.shared import cut_lineage

#: A tree: its panel, its cutoff and its number in the forest.
UNIT = ["panel", "cutoff", "tree"]
#: A node: its tree, and the turns from the root to it, 1 for those who pass the split's test.
NODE = [*UNIT, "path"]
CATEGORIES = ["season", "geography"]
#: Rows of a node up to which it is finished in one task.
SMALL_ROWS = 4_096
#: Share of the squares below which a node counts as pure, and digits by which gains are compared.
PURE, GAIN_DIGITS = 1e-12, 9


def value_column(month: int) -> str:
    return f"m{month}"


def key_column(month: int) -> str:
    return f"k{month}"


def bin_keys(rows: DataFrame, months: Sequence[int], max_bins: int) -> DataFrame:
    """Add the key of each month's value: the value itself where a panel has at most ``max_bins``
    different ones, else the last value of its bin, with equally many different values in each."""
    values = F.array(
        *[F.struct(F.lit(m).alias("month"), F.col(value_column(m)).alias("value")) for m in months]
    )
    listed = cut_lineage(
        rows.select("panel", F.explode(values).alias("v")).select("panel", "v.*").distinct()
    )
    sizes = listed.groupBy("panel", "month").agg(F.count("*").alias("_many"))
    most = sizes.agg(F.max("_many")).first()[0] or 0
    if most <= max_bins:
        return rows.withColumns({key_column(m): F.col(value_column(m)) for m in months})
    ranked = with_row_index(listed, ["panel", "month", "value"], "_r")
    firsts = ranked.groupBy("panel", "month").agg(
        F.min("_r").alias("_first"), F.ceil(F.count("*") / max_bins).alias("_stride")
    )
    ends = ranked.join(firsts, ["panel", "month"]).filter(
        F.pmod(F.col("_r") - F.col("_first"), F.col("_stride")) == F.col("_stride") - 1
    )
    edges = cut_lineage(
        ends.groupBy("panel").agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("month") == m, F.col("value")))).alias(
                    f"_e{m}"
                )
                for m in months
            ]
        )
    )

    def key(month: int) -> Column:
        own = F.col(value_column(month))
        above = F.filter(f"_e{month}", lambda e: e >= own)
        return F.coalesce(F.get(above, F.lit(0)), F.lit(float("inf")))

    keyed = rows.join(edges, "panel").withColumns({key_column(m): key(m) for m in months})
    return keyed.drop(*[f"_e{m}" for m in months])


def draw_samples(rows: DataFrame, n_trees: int, seed: int, resample: bool = True) -> DataFrame:
    """``rows`` for each tree that drew them, with ``tree`` and ``w``, how often.

    A tree makes as many draws with replacement as its panel has rows (``n``, numbered by ``idx``
    from 0), so none is empty. A draw is a hash of seed, tree and number: a lost task repeats it.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    if not resample:
        return rows.select("*", trees, F.lit(1.0).alias("w"))
    chosen = F.pmod(F.xxhash64(F.lit(seed), *UNIT, "idx"), F.col("n"))
    drawn = (
        rows.select("panel", "cutoff", "idx", "n", trees)
        .withColumn("idx", chosen)
        .groupBy("panel", "cutoff", "tree", "idx")
        .agg(F.count("*").cast("double").alias("w"))
    )
    return rows.join(drawn, ["panel", "cutoff", "idx"])


def _histograms(state: DataFrame, months: Sequence[int]) -> DataFrame:
    """Sums of each node per feature and category or key."""
    entries = [
        F.struct(
            F.lit(i).alias("feature"),
            F.col(c).cast("string").alias("label"),
            F.lit(None).cast("double").alias("key"),
            F.lit(None).cast("double").alias("value"),
        )
        for i, c in enumerate(CATEGORIES)
    ] + [
        F.when(
            F.col("last_given") >= m,
            F.struct(
                F.lit(len(CATEGORIES) + i).alias("feature"),
                F.lit(None).cast("string").alias("label"),
                F.col(key_column(m)).alias("key"),
                F.col(value_column(m)).alias("value"),
            ),
        )
        for i, m in enumerate(months)
    ]
    targets = [
        F.when(F.col("last_given") < m, F.col(value_column(m))).otherwise(0.0).alias(f"y{m}")
        for m in months
    ]
    present = F.filter(F.array(*entries), lambda e: e.isNotNull())
    listed = state.select(*NODE, "w", *targets, F.explode(present).alias("e"))
    squares = reduce(Column.__add__, [F.col(f"y{m}") * F.col(f"y{m}") for m in months])
    return listed.groupBy(*NODE, "e.feature", "e.label", "e.key").agg(
        F.sum("w").alias("n"),
        F.sum(F.col("w") * squares).alias("q"),
        F.min("e.value").alias("lo"),
        F.max("e.value").alias("hi"),
        *[F.sum(F.col("w") * F.col(f"y{m}")).alias(f"s{m}") for m in months],
    )


def best_splits(state: DataFrame, months: Sequence[int], min_split: int, may_split: bool) -> DataFrame:
    """One row for each node: size, means of the targets, and its split, if it has one.

    The split with the largest drop of the squared error, summed over all targets, wins; ties go to
    the first feature, then to the smaller label or threshold. Rows of the label, or above the
    threshold, pass. A node is a leaf if its targets are equal, if it is too small, or if no test
    parts its rows.
    """
    hist = _histograms(state, months)
    totals = (
        hist.filter("feature = 0")
        .groupBy(*NODE)
        .agg(
            F.sum("n").alias("n_all"),
            F.sum("q").alias("q_all"),
            *[F.sum(f"s{m}").alias(f"t{m}") for m in months],
        )
    )

    def explained(sums: list[Column], n: Column) -> Column:
        return reduce(Column.__add__, [s * s for s in sums]) / n

    whole = [F.col(f"t{m}") for m in months]
    error = F.col("q_all") - explained(whole, F.col("n_all"))
    totals = totals.withColumn("error", error)
    means = F.array(*[t / F.col("n_all") for t in whole]).alias("means")
    if may_split:
        labelled = hist.filter(F.col("feature") < len(CATEGORIES)).filter("label IS NOT NULL")
        tests = labelled.select(
            *NODE,
            "feature",
            "label",
            F.lit(None).cast("double").alias("threshold"),
            F.col("n").alias("n_part"),
            *[F.col(f"s{m}").alias(f"p{m}") for m in months],
        )
        upto = Window.partitionBy(*NODE, "feature").orderBy("key")
        after = F.lead("lo").over(upto)
        middle = (F.max("hi").over(upto) + after) / 2
        ordered = (
            hist.filter(F.col("feature") >= len(CATEGORIES))
            .select(
                *NODE,
                "feature",
                F.lit(None).cast("string").alias("label"),
                F.when(middle < after, middle).otherwise(F.max("hi").over(upto)).alias("threshold"),
                F.sum("n").over(upto).alias("n_part"),
                *[F.sum(f"s{m}").over(upto).alias(f"p{m}") for m in months],
                after.alias("_after"),
            )
            .filter("_after IS NOT NULL")
            .drop("_after")
        )
        open_nodes = totals.filter(
            (F.col("error") > PURE * F.col("q_all")) & (F.col("n_all") >= min_split)
        )
        scored = tests.unionByName(ordered).join(open_nodes, NODE)
        rest = F.col("n_all") - F.col("n_part")
        parts = [F.col(f"p{m}") for m in months]
        drop = (
            explained(parts, F.col("n_part"))
            + explained([t - p for t, p in zip(whole, parts)], rest)
            - explained(whole, F.col("n_all"))
        )
        loss = -F.round(drop / F.col("error"), GAIN_DIGITS)
        rank = F.struct(loss.alias("loss"), "feature", "label", "threshold")
        best = scored.filter(rest > 0.5).groupBy(*NODE).agg(F.min(rank).alias("best"))
        totals = totals.join(best, NODE, "left")
    else:
        kind = "struct<loss: double, feature: int, label: string, threshold: double>"
        totals = totals.withColumn("best", F.lit(None).cast(kind))
    return totals.select(
        *NODE,
        F.col("n_all").alias("n"),
        means,
        F.col("best.feature").alias("feature"),
        F.col("best.label").alias("label"),
        F.col("best.threshold").alias("threshold"),
    )


def _passes(months: Sequence[int]) -> Column:
    """Whether a row passes the test of the split beside it."""
    category = F.get(F.array(*CATEGORIES), F.col("feature"))
    value = F.get(
        F.array(*[F.col(value_column(m)) for m in months]), F.col("feature") - len(CATEGORIES)
    )
    is_category = F.col("feature") < len(CATEGORIES)
    return F.coalesce(
        F.when(is_category, category == F.col("label")).otherwise(value > F.col("threshold")),
        F.lit(False),
    )


def descend(state: DataFrame, splits: DataFrame, months: Sequence[int]) -> DataFrame:
    """Rows of the nodes in ``splits``, each with the path of its child."""
    beside = state.join(splits.select(*NODE, "feature", "label", "threshold"), NODE)
    turn = F.when(_passes(months), "1").otherwise("0")
    return beside.withColumn("path", F.concat("path", turn)).select(*state.columns)


class SmallTree:
    """The subtree of one node, from all its rows; splits as those of :func:`best_splits`."""

    def __init__(self, rows: pd.DataFrame, months: Sequence[int], min_split: int):
        last = int(rows["last_given"].iloc[0])
        self.months, self.min_split = list(months), min_split
        self.given = [i for i, m in enumerate(months) if m <= last]
        self.w = rows["w"].to_numpy(dtype=float)
        self.values = rows[[value_column(m) for m in months]].to_numpy(dtype=float)
        self.keys = rows[[key_column(m) for m in months]].to_numpy(dtype=float)
        self.y = self.values * (np.asarray(months) > last)
        coded = [pd.factorize(rows[c], sort=True) for c in CATEGORIES]
        self.codes, self.labels = [c for c, _ in coded], [list(names) for _, names in coded]
        self.nodes: list[tuple] = []

    def grow(self, path: str, at: np.ndarray, depth: int | None) -> None:
        """Add the nodes below ``path``, whose rows are ``at``; ``depth`` levels at most."""
        pending = [(path, at, depth)]
        while pending:
            path, at, depth = pending.pop()
            w, y = self.w[at], self.y[at]
            split = None if depth == 0 else self._best(at)
            feature, label, threshold = split or (None, None, None)
            means = (w[:, None] * y).sum(axis=0) / w.sum()
            self.nodes.append((path, w.sum(), means, feature, label, threshold))
            if split:
                passes = self._passes(at, split)
                below = None if depth is None else depth - 1
                pending.append((path + "0", at[~passes], below))
                pending.append((path + "1", at[passes], below))

    def _passes(self, at: np.ndarray, split: tuple) -> np.ndarray:
        feature, label, threshold = split
        if feature < len(CATEGORIES):
            return self.codes[feature][at] == self.labels[feature].index(label)
        return self.values[at, feature - len(CATEGORIES)] > threshold

    def _best(self, at: np.ndarray) -> tuple | None:
        w, y = self.w[at], self.y[at]
        wy, n_all = w[:, None] * y, w.sum()
        total, squares = wy.sum(axis=0), (wy * y).sum()
        base = (total**2).sum() / n_all
        error = squares - base
        if error <= PURE * squares or n_all < self.min_split:
            return None
        found = []

        def offer(feature: int, n: np.ndarray, part: np.ndarray, names: Sequence) -> None:
            rest = n_all - n
            with np.errstate(divide="ignore", invalid="ignore"):
                drop = (part**2).sum(axis=1) / n + ((total - part) ** 2).sum(axis=1) / rest - base
            loss = np.where(rest > 0.5, -np.round(drop / error, GAIN_DIGITS), np.inf)
            if len(loss) and np.isfinite(loss.min()):
                best = int(loss.argmin())
                found.append((loss[best], feature, names[best]))

        for f, codes in enumerate(self.codes):
            own = codes[at]
            seen, place = np.unique(own, return_inverse=True)
            n, part = np.zeros(len(seen)), np.zeros((len(seen), y.shape[1]))
            np.add.at(n, place, w)
            np.add.at(part, place, wy)
            known = seen >= 0
            offer(f, n[known], part[known], [self.labels[f][c] for c in seen[known]])
        for i in self.given:
            key, value = self.keys[at, i], self.values[at, i]
            order = np.lexsort((value, key))
            ends = np.flatnonzero(np.diff(key[order]) > 0)
            high, low = value[order][ends], value[order][ends + 1]
            middle = (high + low) / 2
            n, part = np.cumsum(w[order])[ends], np.cumsum(wy[order], axis=0)[ends]
            offer(len(CATEGORIES) + i, n, part, np.where(middle < low, middle, high).tolist())
        if not found:
            return None
        _, feature, name = min(found, key=lambda x: x[:2])
        return (feature, name, None) if feature < len(CATEGORIES) else (feature, None, name)


def _node_schema(state: DataFrame) -> T.StructType:
    return T.StructType(
        [
            *[state.schema[c] for c in UNIT],
            T.StructField("root", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("n", T.DoubleType()),
            T.StructField("means", T.ArrayType(T.DoubleType())),
            T.StructField("feature", T.IntegerType()),
            T.StructField("label", T.StringType()),
            T.StructField("threshold", T.DoubleType()),
        ]
    )


def _finished(
    state: DataFrame, months: Sequence[int], max_depth: int | None, min_split: int
) -> DataFrame:
    """All nodes from those of ``state`` down, node by node in one task each."""
    schema = _node_schema(state)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        rows = rows.sort_values(CATEGORIES, kind="stable")
        tree = SmallTree(rows, months, min_split)
        depth = None if max_depth is None else max_depth - len(first["path"])
        tree.grow(first["path"], np.arange(len(rows)), depth)
        out = pd.DataFrame(tree.nodes, columns=schema.names[len(UNIT) + 1 :])
        out["feature"] = out["feature"].astype("Int32")
        for i, c in enumerate([*UNIT, "root"]):
            out.insert(i, c, first["path"] if c == "root" else first[c])
        return out

    return state.groupBy(*NODE).applyInPandas(finish, schema)


def grow(
    samples: DataFrame,
    months: Sequence[int],
    path: str,
    max_depth: int | None = None,
    min_split: int = 2,
) -> None:
    """Write the nodes of all trees of ``samples`` to ``path``, a folder for each level.

    ``samples`` has a tree's rows with ``w``, ``last_given`` (the last month that is a feature; later
    ones are targets), ``season``, ``geography``, and for each month its value and its key. Nodes of
    a subtree that one task has grown name its ``root``, and stand in the level of that.
    """
    keys = [key_column(m) for m in months]
    values = [value_column(m) for m in months]
    state = cut_lineage(
        samples.select(
            *UNIT, F.lit("").alias("path"), "w", "last_given", *CATEGORIES, *values, *keys
        )
    )
    spark, level = samples.sparkSession, 0
    while True:
        sizes = cut_lineage(state.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_rows")))
        is_large = F.col("_rows") > SMALL_ROWS
        n_large, n_small = sizes.agg(F.count_if(is_large), F.count_if(~is_large)).first()
        here = f"{path}/level={level}"
        small = state
        if n_large:
            sized = state.join(sizes, NODE)
            small, state = (sized.filter(c).drop("_rows") for c in (~is_large, is_large))
        if n_small:
            _finished(small, months, max_depth, min_split).write.mode("append").parquet(here)
        if not n_large:
            return
        may_split = max_depth is None or level < max_depth
        nodes = best_splits(state, months, min_split, may_split)
        root = F.lit(None).cast("string").alias("root")
        nodes = nodes.select(*UNIT, root, "path", "n", "means", "feature", "label", "threshold")
        split = cut_lineage(nodes)
        split.write.mode("append").parquet(here)
        state = cut_lineage(descend(state, split.filter("feature IS NOT NULL"), months))
        if state.isEmpty():
            return
        level += 1


def _led(rows: pd.DataFrame, nodes: pd.DataFrame, months: Sequence[int]) -> list:
    """Means of the leaf that each row reaches in one subtree."""
    by_path = {n.path: n for n in nodes.itertuples(index=False)}
    columns = {i: rows[value_column(m)].to_numpy(dtype=float) for i, m in enumerate(months)}
    out: list = [None] * len(rows)
    pending = [(nodes["root"].iloc[0], np.arange(len(rows)))]
    while pending:
        path, at = pending.pop()
        if not len(at):
            continue
        node = by_path[path]
        if pd.isna(node.feature):
            for i in at:
                out[i] = node.means
            continue
        feature = int(node.feature)
        if feature < len(CATEGORIES):
            passes = (rows[CATEGORIES[feature]].iloc[at] == node.label).to_numpy(dtype=bool)
        else:
            passes = columns[feature - len(CATEGORIES)][at] > node.threshold
        pending += [(path + "0", at[~passes]), (path + "1", at[passes])]
    return out


def reached(rows: DataFrame, nodes: DataFrame, months: Sequence[int]) -> DataFrame:
    """``rows`` of trees (``UNIT`` and the features) with ``means`` of the leaves that they reach."""
    kept = rows.columns
    # New aliases, because the rows' trees may stem from the nodes that they are joined to.
    rows = rows.select(*[F.col(c).alias(c) for c in kept])
    state, found, small = rows.withColumn("path", F.lit("")), [], []
    large = nodes.filter("root IS NULL")
    for level in sorted(r[0] for r in large.select("level").distinct().collect()):
        here = large.filter(F.col("level") == level).withColumn("_met", F.lit(True))
        split = here.select(*NODE, "feature", "label", "threshold", "means", "_met")
        beside = cut_lineage(state.join(split, NODE, "left"))
        # What has no node here is the root of a subtree.
        small.append(beside.filter("_met IS NULL").select(*kept, "path"))
        found.append(beside.filter("_met AND feature IS NULL").select(*kept, "means"))
        turn = F.when(_passes(months), "1").otherwise("0")
        state = beside.filter("feature IS NOT NULL").withColumn("path", F.concat("path", turn))
        state = state.select(*kept, "path")
    small.append(state)
    schema = T.StructType([*rows.schema.fields, nodes.schema["means"]])

    def lead(own: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        if own.empty or below.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in schema.names})
        return own[kept].assign(means=_led(own, below, months))

    waiting = reduce(DataFrame.unionByName, small)
    below = nodes.filter("root IS NOT NULL").select(
        *[F.col(c).alias(c) for c in nodes.columns if c != "level"]
    )
    ended = (
        waiting.groupBy(*NODE)
        .cogroup(below.groupBy(*UNIT, "root"))
        .applyInPandas(lead, schema)
    )
    return reduce(DataFrame.unionByName, [*found, ended])
