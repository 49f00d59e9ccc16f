"""Quality rules, and how far a text's histograms are from those of its language.

The language references are pooled over all documents that pass the rules: counts of character
classes, and of the language's most frequent words. A document is compared with the reference of
its own language by the Jensen-Shannon distance (the square root of the divergence to base 2, 0 to
1). Short texts are far from anything by chance, so each comparison has a least length, and a
language with little text gives no reference. Texts are read twice: once for the references and
once to be judged; nothing of a text is shuffled but its counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasoncast.llm.common import slices
from seasoncast.sources.shared import cut_lineage

# White space between words, symbols, window of words, least words, largest share.
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

#: Marks of ordinary prose; what is neither these, a letter, a digit nor a blank is another sign.
PROSE = b".,;:!?'\"()-"
CLASSES = ["lower", "upper", "digit", "blank", "prose", "other", "beyond_ascii"]
#: Words in a language's reference. Longer ones than this many bytes are never among them.
COMMON, LONGEST = 50, 64
#: Least characters and words of a text that is compared, and least words of a reference.
LEAST_CHARS, LEAST_COMPARED, LEAST_REFERENCE = 200, 80, 1_000
#: Distances beyond which a text is dropped. On prose of 80 words and more both stay well below.
FAR_CLASSES, FAR_WORDS = 0.25, 0.38
#: Languages up to which their references go to every executor: 6 MB at most, 26 kB for four.
FEW_LANGUAGES = 2_000
SALTS = 64
#: Words that a task counts before it passes them on.
COUNTED = 300_000


def _class_of_byte() -> np.ndarray:
    """Class of each byte that begins a character; bytes within one have the last number."""
    table = np.full(256, CLASSES.index("other"))
    for name, members in (
        ("lower", range(97, 123)),
        ("upper", range(65, 91)),
        ("digit", range(48, 58)),
        ("blank", BLANKS),
        ("prose", PROSE),
        ("beyond_ascii", range(0xC0, 0x100)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    return table


_CLASS = _class_of_byte()


class Measures(NamedTuple):
    """What the rules ask of one text, and its histograms."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    classes: np.ndarray
    words: Counter  # lower-cased in A-Z


def _repeated(ids: np.ndarray) -> int:
    """Words that stand in a window of ``WINDOW`` words that the text has twice or more.

    Runs of 2, 4 and 8 words are numbered exactly, each from two numbers of the one before.
    """
    run, size = ids.astype(np.int64), 1
    while size < WINDOW:
        if len(run) <= size:
            return 0
        run = np.unique((run[:-size] << 32) | run[size:], return_inverse=True)[1]
        size *= 2
    twice = np.flatnonzero(np.bincount(run)[run] > 1)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(raw: bytes | None) -> Measures:
    """Measures of a whole text in UTF-8; null counts as empty."""
    raw = raw or b""
    found, number = raw.split(), {}
    ids = np.fromiter(
        (number.setdefault(w, len(number)) for w in found), dtype=np.int64, count=len(found)
    )
    many = np.bincount(ids, minlength=len(number)).tolist()
    words: Counter = Counter()
    for word, n in zip(number, many):
        words[word.lower()] += n
    bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=bytes_seen, minlength=len(CLASSES) + 1)
    classes = classes[: len(CLASSES)].astype(np.int64)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = _repeated(ids)
    return Measures(
        n_words=len(found),
        word_chars=int(classes.sum() - classes[CLASSES.index("blank")]),
        n_symbols=int(bytes_seen[list(SYMBOLS)].sum()),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated,
        base_failed=len(found) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(found),
        classes=classes,
        words=words,
    )


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, neither of them empty."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2

    def toward(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / middle[some])).sum())

    return max(0.0, (toward(p) + toward(q)) / 2) ** 0.5


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    return docs.select(lang, F.col("text").cast("string").cast("binary").alias("text"), *columns)


def language_references(docs: DataFrame) -> DataFrame:
    """``lang, n_words, common, word_counts, class_counts``: one row a language, null being ``''``.

    Counts cover all documents that pass the rules; ``word_counts`` has one more entry than
    ``common``, for all other words. Ties among words go to the smaller one. Languages with less
    than ``LEAST_REFERENCE`` words have no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, Counter]] = {}

        def rows() -> pa.RecordBatch:
            out = [
                (lang, word, n)
                for lang, (classes, words) in seen.items()
                for word, n in [*((f"{i}", int(c)) for i, c in enumerate(classes)), *words.items()]
            ]
            # Words are binary, classes are named by number under kind 0.
            kinds = [isinstance(word, bytes) for _, word, _ in out]
            items = [w if isinstance(w, bytes) else w.encode() for _, w, _ in out]
            return pa.record_batch(
                [
                    pa.array([lang for lang, _, _ in out], pa.string()),
                    pa.array(kinds, pa.bool_()),
                    pa.array(items, pa.binary()),
                    pa.array([n for _, _, n in out], pa.int64()),
                ],
                names=["lang", "is_word", "item", "n"],
            )

        for batch in slices(batches):
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = measure(raw)
                if one.base_failed:
                    continue
                classes, words = seen.setdefault(lang, (np.zeros(len(CLASSES), np.int64), Counter()))
                classes += one.classes
                words[b""] += one.n_words
                words.update({w: n for w, n in one.words.items() if len(w) <= LONGEST})
            if sum(len(words) for _, words in seen.values()) > COUNTED:
                yield rows()
                seen.clear()
        yield rows()

    parts = _texts(docs).mapInArrow(count, "lang string, is_word boolean, item binary, n long")
    counts = cut_lineage(parts.groupBy("lang", "is_word", "item").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top = (
        counts.filter("is_word AND item <> X''")
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= COMMON)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "item", "n"))).alias("_top"))
    )
    total = counts.filter("is_word AND item = X''").select("lang", F.col("n").alias("n_words"))
    place = F.col("item").cast("string").cast("int")
    classes = (
        counts.filter("NOT is_word")
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "n"))).alias("_classes"))
    )
    listed = F.transform("_top", lambda x: x["n"])
    rest = F.col("n_words") - F.aggregate(listed, F.lit(0).cast("long"), lambda s, x: s + x)
    return cut_lineage(
        total.filter(F.col("n_words") >= LEAST_REFERENCE)
        .join(top, "lang")
        .join(classes, "lang")
        .select(
            "lang",
            "n_words",
            F.transform("_top", lambda x: x["item"]).alias("common"),
            F.concat(listed, F.array(rest)).alias("word_counts"),
            F.transform("_classes", lambda x: x["n"]).alias("class_counts"),
        )
    )


def _beside_references(texts: DataFrame, references: DataFrame) -> DataFrame:
    """Each text with the reference of its language; texts stay where they are if there are few
    languages, else both sides meet by language and salt."""
    if references.count() <= FEW_LANGUAGES:
        return texts.join(F.broadcast(references), "lang", "left")
    salted = references.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = texts.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["lang", "_salt"], "left")


_JUDGED = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, class_distance double, word_distance double, "
    "kept boolean"
)


def judge(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: measures, ``class_distance``, ``word_distance``, ``kept``.

    A word is a run of bytes other than blank, tab to carriage return; null text has none.
    ``base_failed``: fewer than 20 words, or over 30 % of them in 8-word windows that the text
    repeats. ``kept`` is false for those, and for texts farther than ``FAR_CLASSES`` or
    ``FAR_WORDS`` from the reference of their language. A distance is null, and rejects nothing,
    for texts under ``LEAST_CHARS`` characters or ``LEAST_COMPARED`` words and where the language
    has no reference. Repeated rows and null ids are rows like others; null languages are one
    language; other columns are not read. ``references`` are those of ``docs`` unless given.
    """
    if references is None:
        references = language_references(docs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            known: dict[str, tuple[dict[bytes, int], np.ndarray, np.ndarray] | None] = {}
            for i, lang in enumerate(langs):
                if lang in known:
                    continue
                common = batch.column("common")[i].as_py()
                known[lang] = common and (
                    {w: at for at, w in enumerate(common)},
                    np.array(batch.column("word_counts")[i].as_py(), dtype=np.float64),
                    np.array(batch.column("class_counts")[i].as_py(), dtype=np.float64),
                )
            out: list[list] = [[] for _ in range(9)]
            for lang, raw in zip(langs, batch.column("text").to_pylist()):
                one, by_class, by_word = measure(raw), None, None
                if reference := known[lang]:
                    at, word_counts, class_counts = reference
                    if one.classes.sum() >= LEAST_CHARS:
                        by_class = js_distance(one.classes.astype(np.float64), class_counts)
                    if one.n_words >= LEAST_COMPARED:
                        own = np.array([*(one.words.get(w, 0) for w in at), 0], dtype=np.float64)
                        own[-1] = one.n_words - own.sum()
                        by_word = js_distance(own, word_counts)
                far = (by_class or 0.0) > FAR_CLASSES or (by_word or 0.0) > FAR_WORDS
                row = (*one[:6], by_class, by_word, not (one.base_failed or far))
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("lang"),
                    *(pa.array(c, t) for c, t in zip(out, types)),
                ],
                names=[f.split(" ")[0] for f in _JUDGED.split(", ")],
            )

    texts = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    beside = _beside_references(texts, references)
    columns = ["doc_id", "lang", "text", "common", "word_counts", "class_counts"]
    return beside.select(*columns).mapInArrow(make, _JUDGED)
