"""Personal data in texts: fixed patterns, and spans that a trained character tagger adds.

The tagger learns from windows whose spans the patterns label. It reads windows around the
characters without which none of the kinds exists (digits and ``@``); windows overlap, each
character takes the tag of the window in which it lies furthest from the borders, and spans are read
from the tags of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.common import hash_sample, slices
from seasoncast.llm.span_tagger import PAD, Tagger, classes
from seasoncast.sources.shared import cut_lineage

#: Kinds in the order in which they are reported.
KINDS = ("email", "ip", "card", "phone")
N_TAGS = 1 + 2 * len(KINDS)
#: Characters in a window and from one window to the next.
WINDOW, STRIDE = 64, 32
#: Labelled windows, about, that the tagger is fitted on at most; chosen by a hash of the window.
TRAINING_WINDOWS = 3_000
#: Windows decoded at once.
DECODED = 512

# The patterns and limits of the kinds.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Matches at every digit, so a long run is read once.
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TRIGGER = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one ``@``, so it begins where the run of local characters before one does."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of every run of numbers and dots."""
    for run in _NUMBERS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + length
            at += length + 1


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = sum(sum(divmod(2 * d, 10)) for d in values[1::2])
    return (sum(values[::2]) + doubled) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, s, e) for s, e in _addresses(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def window_starts(text: str) -> list[int]:
    """Windows at multiples of the stride that hold a digit or an ``@``."""
    wanted: set[int] = set()
    for m in _TRIGGER.finditer(text):
        last = m.start() // STRIDE
        wanted.update(range(max(0, last - WINDOW // STRIDE + 1), last + 1))
    return [k * STRIDE for k in sorted(wanted)]


def _windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([codes, np.full(WINDOW, PAD, dtype=codes.dtype)])
    return padded[np.asarray(starts)[:, None] + np.arange(WINDOW)]


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    """Tags of a whole text; of overlapping spans the kind named first wins."""
    tags = np.zeros(length, dtype=np.int64)
    for kind, start, end in sorted(spans, reverse=True):
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def _plausible(kind: int, found: str) -> bool:
    """What makes a span one of its kind, whatever the tagger thinks; the limits are those of the
    patterns, so a number that fails its check sum is left alone."""
    digits = "".join(_DIGIT.findall(found))
    parts = re.findall("[0-9]+", found)
    return (
        "@" in found.strip("@"),
        len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        13 <= len(digits) <= 19 and _luhn(digits),
        9 <= len(digits) <= 15,
    )[kind] and not found[0].isspace() and not found[-1].isspace()


def _read(text: str, tags: np.ndarray, first: int) -> list[Span]:
    """Spans of tags that begin at ``first`` in the text."""
    out, kind, start = [], -1, 0
    for i, tag in enumerate([*tags.tolist(), 0]):
        inside = tag and (tag - 1) // 2 == kind and tag % 2 == 0
        if kind >= 0 and not inside:
            if _plausible(kind, text[first + start : first + i]):
                out.append((kind, first + start, first + i))
            kind = -1
        if tag and not inside:
            kind, start = (tag - 1) // 2, i
    return out


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of whole texts from the tags of their windows."""
    starts = [window_starts(t) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    queue = [(i, k) for i, own in enumerate(starts) for k in own]
    decoded: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(queue), DECODED):
        some = queue[at : at + DECODED]
        chosen = sorted({i for i, _ in some})
        x = np.concatenate(
            [_windows(classes(texts[i]), [k for j, k in some if j == i]) for i in chosen]
        )
        for (i, k), tags in zip(some, tagger.decode(x)):
            decoded.setdefault(i, []).append((k, tags))
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for i, windows in decoded.items():
        run: list[tuple[int, np.ndarray]] = []
        for k, tags in [*windows, (None, None)]:
            if run and (k is None or k > run[-1][0] + STRIDE):
                first, last = run[0][0], run[-1][0] + WINDOW
                best, merged = np.full(last - first, -1), np.zeros(last - first, dtype=np.int64)
                for s, own in run:
                    part = slice(s - first, s - first + WINDOW)
                    deeper = depth > best[part]
                    merged[part][deeper] = own[deeper]
                    best[part][deeper] = depth[deeper]
                length = len(texts[i])
                out[i] += _read(texts[i], merged[: max(0, length - first)], first)
                run = []
            run.append((k, tags))
    return out


def find_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and all spans with those that the tagger adds.

    The tagger's spans that touch one of the patterns are left out.
    """
    base = [base_spans(t) for t in texts]
    added = tagged_spans(texts, tagger) if tagger else [[] for _ in texts]
    out = []
    for fixed, more in zip(base, added):
        taken = sorted((s, e) for _, s, e in fixed)
        new = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
        out.append((sorted(fixed), sorted(set(fixed) | set(new))))
    return out


def train(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Tagger | None:
    """A tagger from windows of ``docs`` that the patterns label; None if they find nothing.

    At most ``TRAINING_WINDOWS`` windows are taken, half of them with spans where there are as many.
    Phones are also shown without the leading country code, which the patterns would not take.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, tags = [], []
            for t in batch.column(0).to_pylist():
                starts = window_starts(t)
                if not starts:
                    continue
                whole = _tags(len(t), base_spans(t)).astype(np.uint8)
                for s in starts:
                    found.append(t[s : s + WINDOW])
                    tags.append(whole[s : s + WINDOW].tobytes())
            yield pa.record_batch(
                [pa.array(found, pa.string()), pa.array(tags, pa.binary())], names=["text", "tags"]
            )

    with_trigger = docs.select(F.col(text).cast("string")).filter(F.col(text).rlike("[0-9@]"))
    windows = with_trigger.mapInArrow(cut, "text string, tags binary").distinct()
    marked = F.instr(F.hex("tags"), "1") + F.instr(F.hex("tags"), "3") + F.instr(F.hex("tags"), "5")
    marked = (marked + F.instr(F.hex("tags"), "7")) > 0
    stored, keys = cut_lineage(windows), ["text", "tags"]
    rows = hash_sample(stored.filter(marked), keys, TRAINING_WINDOWS // 2).collect()
    if not rows:
        return None
    rest = max(1, TRAINING_WINDOWS - len(rows))
    rows = sorted(rows + hash_sample(stored.filter(~marked), keys, rest).collect())
    x, y = [], []
    for row in rows:
        tags = np.frombuffer(row["tags"], dtype=np.uint8).astype(np.int64)
        shown = [(row["text"], tags)]
        if (tags >= 7).any():
            plus = [i for i in np.flatnonzero(tags == 7) if row["text"][i] == "+"]
            if plus and plus[0] + 3 < len(tags):
                at = plus[0]
                bare = np.delete(tags, [at, at + 1, at + 2])
                if bare[at:].any() and bare[at] == 8:
                    bare[at] = 7
                    shown.append((row["text"][:at] + row["text"][at + 3 :], bare))
        for t, own in shown:
            x.append(np.pad(classes(t), (0, WINDOW - len(own))))
            y.append(np.pad(own, (0, WINDOW - len(own))))
    return Tagger.fit(np.stack(x), np.stack(y), N_TAGS)


def find_pii(text: Column, tagger: Tagger | None) -> Column:
    """``struct<base, spans>``: lists of ``kind, start, stop`` in code points, ordered by kind and
    start; ``base`` are those of the patterns. Null counts as empty, which has none."""
    item = "array<struct<kind: string, start: long, stop: long>>"

    @F.arrow_udf(f"base {item}, spans {item}")
    def spans(texts: pa.Array) -> pa.Array:
        given = [t.as_py() or "" for t in texts]
        rows = []
        for at in range(0, len(given), 256):
            rows += find_spans(given[at : at + 256], tagger)
        one = lambda own: [{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in own]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        return pa.StructArray.from_arrays(
            [pa.array([one(r[i]) for r in rows], pa.list_(kind)) for i in (0, 1)], ["base", "spans"]
        )

    return spans(text)


def redact(text: Column, tagger: Tagger | None) -> Column:
    """Whole texts with every span replaced by its kind in angle brackets; of spans that overlap,
    one mark for all of them, named by the first. Null stays null."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        given = [t.as_py() for t in texts]
        out: list[str | None] = []
        for at in range(0, len(given), 256):
            some = given[at : at + 256]
            for t, (_, spans) in zip(some, find_spans([t or "" for t in some], tagger)):
                if not spans:
                    out.append(t)
                    continue
                parts, end = [], 0
                for s, e, kind in sorted((s, e, k) for k, s, e in spans):
                    if s >= end:
                        parts += [t[end:s], f"<{KINDS[kind].upper()}>"]
                    end = max(end, e)
                out.append("".join([*parts, t[end:]]))
        return pa.array(out, pa.string())

    return replaced(text)
