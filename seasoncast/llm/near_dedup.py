"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full sets.

Each tree of the forest is one order of the signature. Documents that agree on its first values
form a region; a region that is too large goes deeper by one value at a time. In the sorted order
of a region, neighbours have the longest common prefixes: they are tried first, the most similar
first. Pairs of a region that these links do not put into one component are tried after that, and
at last those that only going deeper has separated, so no link between two documents that agree on
the first values of a tree is lost; copies and members of one component are never paired with each
other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.common import map_slices
from seasoncast.llm.components import components
from seasoncast.sources.shared import cut_lineage

#: Two documents with similarity 0.8 agree on the first four values of a tree with probability
#: 0.41, hence on those of none of 24 trees with 3 in a million.
TREES, DEPTH, DEEPEST = 24, 4, 8
VALUES = TREES * DEPTH + 32
#: Documents in a region before it goes deeper.
REGION = 16_384
#: Regions up to this size give their pairs by a join, larger ones in blocks.
SMALL = 32
BLOCK = 256
#: Shingles of a set that goes along to its blocks, where its pairs are confirmed at once. Pairs with
#: a larger set come out and are confirmed by joins.
CARRIED = 2_048
#: Six standard deviations of the estimate from ``VALUES`` values, below the threshold: a pair at
#: the threshold is lost with one in a thousand million.
SLACK = 6.0

_SETS = "doc_id long, n long, set_key binary, keys array<long>, deep array<long>, codes binary"


#: Bytes of a text whose words are hashed at once.
HASHED = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


class WordHasher:
    """64-bit hashes of the words of a text, without a Python object a word.

    A word's hash is the sum over its bytes of a random number of the byte (A-Z as a-z) times a power
    for its place, mixed.
    """

    def __init__(self, draw: np.random.Generator):
        lower = np.arange(256)
        lower[65:91] += 32
        self._of_byte = draw.integers(1, 2**63, 256, dtype=np.uint64)[lower]
        self._step = draw.integers(1, 2**62, 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers = np.cumprod(np.repeat(self._step, 64))

    def _some(self, raw: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(~_BLANK[raw])
        if not len(at):
            return np.empty(0, dtype=np.uint64)
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        sizes = np.diff(first, append=len(at))
        if sizes.max() > len(self._powers):
            self._powers = np.cumprod(np.repeat(self._step, sizes.max()))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        mixed = np.add.reduceat(self._of_byte[raw[at]] * self._powers[place], first)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def words(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        parts, start = [], 0
        while start < len(raw):
            stop = start + HASHED
            if stop < len(raw):
                blanks = np.flatnonzero(_BLANK[raw[stop : stop + HASHED]])
                while not len(blanks) and stop < len(raw):
                    stop += HASHED
                    blanks = np.flatnonzero(_BLANK[raw[stop : stop + HASHED]])
                stop = stop + int(blanks[0]) if len(blanks) else len(raw)
            parts.append(self._some(raw[start:stop]))
            start = stop
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their signatures."""

    def __init__(self, words: int):
        self.words = words
        draw = np.random.default_rng(20_240_601)
        self._factors = draw.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._adds = draw.integers(0, 2**63, VALUES, dtype=np.uint64)
        rest = np.arange(TREES * DEPTH, VALUES)
        self._deeper = np.stack(
            [draw.permutation(rest)[: DEEPEST - DEPTH] for _ in range(TREES)]
        )
        self._hasher = WordHasher(draw)

    def shingles(self, text: str | None) -> np.ndarray:
        hashes = self._hasher.words((text or "").encode())
        if not len(hashes):
            return np.empty(0, dtype=np.uint64)
        size = min(self.words, len(hashes))
        mixed = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for i in range(size):
            mixed = (mixed ^ hashes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for start in range(0, len(shingles), 2048):
            part = shingles[start : start + 2048, None] * self._factors + self._adds
            np.minimum(least, part.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint64)

    def order_keys(self, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree the first values as one number, and the next ones, 16 bits each."""
        keys = np.arange(TREES, dtype=np.uint64)
        for column in signature[: TREES * DEPTH].reshape(TREES, DEPTH).T:
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
        deep = np.zeros(TREES, dtype=np.uint64)
        for column in signature[self._deeper].T:
            deep = (deep << np.uint64(16)) | (column & np.uint64(0xFFFF))
        return keys.view(np.int64), deep.view(np.int64)


@lru_cache(maxsize=2)
def _shingler(words: int) -> Shingler:
    return Shingler(words)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _shingler(words)
        rows: list[list] = [[], [], [], [], []]
        for text in batch.column(1).to_pylist():
            found = own.shingles(text)
            if len(found):
                signature = own.signature(found)
                keys, deep = own.order_keys(signature)
                codes = signature.astype(np.uint8).tobytes()
                key = xxhash.xxh3_128_digest(found.tobytes())
            else:
                keys, deep, codes, key = [], [], b"", None
            for column, value in zip(rows, (len(found), key, keys, deep, codes)):
                column.append(value)
        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.record_batch(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))],
            names=["doc_id", "n", "set_key", "keys", "deep", "codes"],
        )

    return map_slices(docs, make, _SETS)


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _shingler(words)
        sets = [own.shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "set"])

    return map_slices(docs, make, "rep long, set binary")


def _regions(trees: DataFrame) -> DataFrame:
    """``rep, n, deep, region, size, wide, wide_size`` for documents that share the first values of a
    tree with others. ``wide`` is the region before it goes deeper; ``region`` may hold one alone."""

    def sized(rows: DataFrame, depth: int) -> DataFrame:
        below = 16 * (DEEPEST - depth)
        # A shift by 64 bits would be none at all.
        prefix = F.shiftrightunsigned("deep", below) if below < 64 else F.lit(0).cast("long")
        keyed = rows.withColumn("region", F.xxhash64("tree", "key", prefix, F.lit(depth)))
        sizes = keyed.groupBy("region").agg(F.count("*").alias("size"))
        # Whoever is alone in a deeper region is still to meet the others of the wide one.
        shared = sizes.filter("size > 1") if depth == DEPTH else sizes
        return cut_lineage(keyed.join(shared, "region"))

    first = sized(trees, DEPTH)
    rows, done = first.withColumns({"wide": F.col("region"), "wide_size": F.col("size")}), None
    for depth in range(DEPTH + 1, DEEPEST + 1):
        large = rows.filter(F.col("size") > REGION)
        if large.isEmpty():
            break
        small = rows.filter(F.col("size") <= REGION)
        done = small if done is None else done.unionByName(small)
        rows = sized(large.drop("region", "size"), depth)
    return rows if done is None else done.unionByName(rows)


class _Pairs:
    """Estimates and exact checks of pairs ``a < b``."""

    def __init__(self, reps: DataFrame, sets: DataFrame, percent: int):
        self.reps, self.sets, self.percent = reps, sets, percent
        share = percent / 100
        self.least = share - SLACK * (share * (1 - share) / VALUES) ** 0.5
        self.checked: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """``a, b, estimate`` of pairs whose sizes and estimate allow a link."""
        least = self.least

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, VALUES)
                    for i in (2, 3)
                )
                share = (a == b).mean(axis=1) if len(a) else np.empty(0)
                out = pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(share, pa.float64())],
                    names=["a", "b", "estimate"],
                )
                yield out.filter(pa.array(share >= least))

        one = self.reps.select(F.col("rep").alias("a"), F.col("n").alias("_na"), F.col("codes").alias("_ca"))
        two = self.reps.select(F.col("rep").alias("b"), F.col("n").alias("_nb"), F.col("codes").alias("_cb"))
        sized = (
            pairs.join(one, "a")
            .join(two, "b")
            .filter(100 * F.least("_na", "_nb") >= self.percent * F.greatest("_na", "_nb"))
        )
        return cut_lineage(
            sized.select("a", "b", "_ca", "_cb").mapInArrow(
                estimate, "a long, b long, estimate double"
            )
        )

    def confirm(self, pairs: DataFrame) -> None:
        """Intersections of full sets."""
        percent = self.percent

        def check(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            return pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                names=["a", "b", "linked"],
            )

        one = self.sets.select(F.col("rep").alias("a"), F.col("set").alias("_a"))
        two = self.sets.select(F.col("rep").alias("b"), F.col("set").alias("_b"))
        both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "_a", "_b")
        found = cut_lineage(map_slices(both, check, "a long, b long, linked boolean"))
        self.checked = found if self.checked is None else self.checked.unionByName(found)

    def labels(self) -> DataFrame:
        return components(self.checked.filter("linked"))

    def add_links(self, links: DataFrame) -> None:
        """Pairs confirmed elsewhere."""
        self.checked = self.checked.unionByName(links.withColumn("linked", F.lit(True)))

    def unchecked(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.checked.select("a", "b"), ["a", "b"], "left_anti")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose documents are in different components."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("_ka"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("_kb"))
    return (
        pairs.join(one, "a", "left")
        .join(two, "b", "left")
        .filter(F.coalesce("_ka", "a") != F.coalesce("_kb", "b"))
        .drop("_ka", "_kb")
    )


def _split_regions(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the regions that hold more than one component, with ``kind``, the component, and
    ``top`` and ``n_top``, the most frequent one of the region and its rows."""
    named = regions.join(
        labels.select(F.col("node").alias("rep"), F.col("component").alias("_k")), "rep", "left"
    ).withColumn("kind", F.coalesce("_k", "rep"))
    many = named.groupBy("region", "kind").agg(F.count("*").alias("_rows"))
    mixed = (
        many.groupBy("region")
        .agg(F.count("*").alias("_kinds"), F.max(F.struct("_rows", "kind")).alias("_top"))
        .filter("_kinds > 1")
        .select("region", F.col("_top.kind").alias("top"), F.col("_top._rows").alias("n_top"))
    )
    return named.join(mixed, "region").drop("_k")


def _places(regions: DataFrame) -> DataFrame:
    """For each document the trees in which it shares a region, and those regions."""
    at = F.array_sort(F.collect_list(F.struct("tree", "region")))
    return (
        regions.groupBy("rep")
        .agg(at.alias("_at"))
        .select(
            "rep",
            F.transform("_at", lambda x: x["tree"]).alias("trees"),
            F.transform("_at", lambda x: x["region"]).alias("places"),
        )
    )


def _earlier(rows: pd.DataFrame, tree: int) -> np.ndarray:
    """Regions in the trees before ``tree``, one row a document; one of its own where it has none."""
    out = np.repeat(-1 - rows["rep"].to_numpy()[:, None], tree, axis=1)
    for own, trees, places in zip(out, rows["trees"], rows["places"]):
        before = np.asarray(trees) < tree
        own[np.asarray(trees)[before]] = np.asarray(places)[before]
    return out


def _common(row: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with other sets, none of them empty."""
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(row, values), len(row) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((row[at] == values).astype(np.int64), starts)


def _links(a: np.ndarray, b: np.ndarray, left: list, right: list, percent: int) -> np.ndarray:
    """Which pairs of the sets ``left[a]`` and ``right[b]`` are linked; ``a`` ascends."""
    linked = np.zeros(len(a), dtype=bool)
    for i in np.unique(a):
        at = np.flatnonzero(a == i)
        others = [right[j] for j in b[at]]
        sizes = np.array([len(x) for x in others])
        common = _common(left[i], others)
        linked[at] = 100 * common >= percent * (len(left[i]) + sizes - common)
    return linked


def _sets_of(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint64) for x in column]


def _block_pairs(rows: DataFrame, reps: DataFrame, least: float, percent: int, most: int | None) -> DataFrame:
    """``a, b, linked`` for different components in large regions, block against block.

    A pair belongs to the first tree in which it shares a region. Likely pairs of carried sets are
    confirmed here: of those that are linked, one for each pair of components comes out, which
    joins them as well as all would. Likely pairs with a larger set come out with a null; with
    ``most``, only so many of a document's partners in one component and block, the likeliest,
    and without it all of those and no others.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "block"])
        first, second = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = rows[rows["block"] == first], rows[rows["block"] == second]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "linked": []})
        a, b = (
            np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(-1, VALUES) for x in (left, right)
        )
        share = np.stack([(b == row).mean(axis=1) for row in a])
        na, nb = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
        good = (share >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        good &= left["kind"].to_numpy()[:, None] != right["kind"].to_numpy()[None, :]
        tree = int(rows["tree"].iloc[0])
        for x, y in zip(_earlier(left, tree).T, _earlier(right, tree).T):
            good &= x[:, None] != y[None, :]
        if first == second:
            good &= left["rep"].to_numpy()[:, None] < right["rep"].to_numpy()[None, :]
        both = (na <= CARRIED) & (nb <= CARRIED)

        def listed(chosen: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
            x, y = np.nonzero(chosen)
            pairs = pd.DataFrame(
                {
                    "a": left["rep"].to_numpy()[x],
                    "b": right["rep"].to_numpy()[y],
                    "ka": left["kind"].to_numpy()[x],
                    "kb": right["kind"].to_numpy()[y],
                    "estimate": share[x, y],
                }
            )
            return pairs, x, y

        open_pairs, _, _ = listed(good & ~both)
        parts = []
        if most is None:
            parts.append(open_pairs.assign(linked=None))
        else:
            open_pairs = open_pairs.sort_values("estimate", ascending=False, kind="stable")
            near = open_pairs.groupby(["a", "kb"]).cumcount() < most
            near &= open_pairs.groupby(["b", "ka"]).cumcount() < most
            parts.append(open_pairs[near].assign(linked=None))
            pairs, x, y = listed(good & both)
            linked = _links(x, y, _sets_of(left["set"]), _sets_of(right["set"]), percent)
            parts.append(pairs[linked].drop_duplicates(["ka", "kb"]).assign(linked=True))
        out = pd.concat([p for p in parts if len(p)] or [parts[0]])
        ends = out[["a", "b"]]
        return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1), "linked": out["linked"]})

    # Rows of the most frequent component have blocks of their own, which meet those of others only.
    others = F.ceil((F.col("size") - F.col("n_top")) / BLOCK)
    tops = F.ceil(F.col("n_top") / BLOCK)
    is_top = F.col("kind") == F.col("top")
    at = F.when(is_top, others + F.pmod(F.xxhash64("rep"), tops)).otherwise(
        F.pmod(F.xxhash64("rep"), others)
    )
    last = F.when(is_top, others).otherwise(others + tops) - 1
    carried = ["rep", "codes", "trees", "places", "set"]
    dealt = rows.withColumn("block", at.cast("int")).join(reps.select(*carried), "rep")
    met = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    keyed = met.withColumns({"i": F.least("block", "_with"), "j": F.greatest("block", "_with")})
    columns = ["tree", "region", "i", "j", "block", "n", "kind", *carried]
    return (
        keyed.select(*columns)
        .groupBy("region", "i", "j")
        .applyInPandas(compare, "a long, b long, linked boolean")
        .distinct()
    )


def _confirm_large(pairs: _Pairs, large: DataFrame, placed: DataFrame) -> None:
    """Pairs of different components in the large regions of ``large``."""
    for most in (8, None):
        found = cut_lineage(_block_pairs(large, placed, pairs.least, pairs.percent, most))
        pairs.add_links(found.filter("linked").select("a", "b"))
        pairs.confirm(pairs.unchecked(found.filter("linked IS NULL")))
        if most:
            # Carried sets are settled; what is left are regions with larger ones.
            open_regions = large.filter(F.col("n") > CARRIED).select("region").distinct()
            large = large.join(open_regions, "region", "left_semi").drop("kind", "top", "n_top")
            large = cut_lineage(_split_regions(large, pairs.labels()))
            if large.isEmpty():
                break


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Words are what stands between blanks (space, tab to carriage return), A-Z lower-cased; a set
    holds the distinct runs of ``words`` words, or all words as one run if there are fewer. Two
    documents are linked if 100 * common >= percent * united. ``component_id`` is the smallest
    doc_id that links lead to, ``kept`` says that it is the document's own. Null and empty texts
    have no shingles and no links. Rows that share a doc_id count as linked; rows with a null
    doc_id are linked with nothing, have a null component and are kept. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut_lineage(_signed(texts, words))
    classes = cut_lineage(
        signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n", "keys", "deep", "codes")).alias("c"))
        .select("set_key", F.col("c.doc_id").alias("rep"), "c.n", "c.keys", "c.deep", "c.codes")
    )
    trees = classes.select(
        "rep", "n", F.posexplode(F.arrays_zip("keys", "deep")).alias("tree", "_at")
    ).select("rep", "n", "tree", F.col("_at.keys").alias("key"), F.col("_at.deep").alias("deep"))
    regions = _regions(trees)
    near = cut_lineage(regions.select("rep").distinct())
    reps = cut_lineage(classes.join(near, "rep", "left_semi").select("rep", "n", "codes"))
    read = texts.join(near.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    pairs = _Pairs(reps, cut_lineage(_full_sets(read, words)), percent)

    before = F.lag("rep").over(Window.partitionBy("region").orderBy("deep", "rep"))
    lcp = regions.select("rep", before.alias("_other")).filter("_other IS NOT NULL AND _other <> rep")
    chain = pairs.likely(
        lcp.select(F.least("rep", "_other").alias("a"), F.greatest("rep", "_other").alias("b")).distinct()
    )
    # The most similar neighbour of each document first, then the next one, then all others whose
    # documents are still apart.
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("estimate"), "b"))
    best_too = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("estimate"), "a"))
    ranked = chain.withColumn("_r", F.least(best, best_too))
    pairs.confirm(ranked.filter("_r = 1"))
    labels = pairs.labels()
    pairs.confirm(_apart(pairs.unchecked(ranked.filter("_r <= 3")), labels))
    labels = pairs.labels()
    pairs.confirm(_apart(pairs.unchecked(chain), labels))
    labels = pairs.labels()

    mixed = cut_lineage(_split_regions(regions, labels))
    small = mixed.filter(F.col("size") <= SMALL)
    other = small.select("region", F.col("rep").alias("_b"), F.col("kind").alias("_kind"))
    joined = small.join(other, "region").filter("rep < _b AND kind <> _kind")
    rest = joined.select(F.col("rep").alias("a"), F.col("_b").alias("b")).distinct()
    pairs.confirm(pairs.likely(pairs.unchecked(rest)))
    large = mixed.filter(F.col("size") > SMALL)
    gone_deeper = regions.filter(F.col("wide_size") > REGION)
    deeper = not gone_deeper.isEmpty()
    if deeper or not large.isEmpty():
        carried = pairs.sets.join(reps.filter(F.col("n") <= CARRIED), "rep", "left_semi")
        carrying = cut_lineage(reps.join(carried, "rep", "left"))
    if not large.isEmpty():
        _confirm_large(pairs, large, cut_lineage(carrying.join(_places(regions), "rep")))
    if deeper:
        # Agreeing on the first values is what makes a pair, so those of one wide region that are
        # still apart meet too; a pair belongs to the first tree in which both share such a region.
        wide = gone_deeper.drop("region", "size").withColumnsRenamed(
            {"wide": "region", "wide_size": "size"}
        )
        apart = cut_lineage(_split_regions(wide, pairs.labels()))
        if not apart.isEmpty():
            _confirm_large(pairs, apart, cut_lineage(carrying.join(_places(wide), "rep")))
    labels = pairs.labels()

    named = classes.select("set_key", "rep").join(
        labels.select(F.col("node").alias("rep"), F.col("component").alias("_k")), "rep", "left"
    )
    # Rows that share a doc_id count as linked: their sets take the smallest component.
    known = named.select("set_key", F.coalesce("_k", "rep").alias("_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return (
        signed.select("doc_id", "n", "set_key")
        .join(known, "set_key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
