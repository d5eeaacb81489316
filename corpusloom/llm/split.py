"""Cut oversized texts at natural boundaries, each piece repeating the end of the one before.

Every position of a text has a strength: how natural a cut before it would be (between paragraphs, list items or
transcript minutes, lines, sentences, words, or none; inside a tag it is worse than none). A sparse table answers
"the strongest position in this window, the rightmost of equals" in constant time, and the splitter asks it for the
window of lengths that a piece may have, cuts there, steps back by the overlap and goes on. Strengths and table cover a
bounded stretch of text at a time, so that beside the text itself memory doesn't follow its length.

Lengths are Unicode code points. Null has no piece, an empty text one empty piece; a text within the limit is its
own only piece and never leaves the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrowtext import over_slices
from corpusloom.session import ship

LIMIT, OVERLAP = 4800, 200
#: Positions that one sparse table covers.
STRETCH = 1 << 16
TAG, NONE, WORD, SENTENCE, LINE, ITEM, BLOCK = range(7)
_PATTERNS = (
    (WORD, re.compile(r"\s(?=\S)")),
    (SENTENCE, re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+(?=\S)|(?<=[。！？])(?=[^\s。！？」』])")),
    (LINE, re.compile(r"\n(?=[^\n])|<br\s*/?>\s*", re.I)),
    (ITEM, re.compile(r"\n(?=[ \t]*(?:[-*+•]|\d+[.)])[ \t])|(?=<(?:li|tr|dt|dd)\b)|(?=<p>\[\d+:\d\d)|(?<!>)(?=\[\d+:\d\d(?::\d\d)?\] )", re.I)),
    (BLOCK, re.compile(r"\n[ \t]*\n\s*|(?=<(?:p|div|h[1-6]|ul|ol|table|blockquote|pre|section|article)\b)(?!<p>\[\d)", re.I)),
)
_ENTITY = re.compile(r"&#?\w{1,8};")
_OPENS = re.compile(r"<[a-zA-Z/!]")
#: Characters around a stretch that are read with it. A run of white space longer than this counts as beginning within them.
MARGIN = 4096


def strengths(text: str, low: int = 0, high: int | None = None) -> np.ndarray:
    """The strength of a cut before each position from ``low`` to ``high`` (the end), both included.

    Only the stretch and its margins are searched; a tag of any length is told by its angle brackets: from one that opens
    it to the next of either kind, if that closes.
    """
    high = len(text) if high is None else high
    first, last = max(0, low - MARGIN), min(len(text), high + MARGIN)
    while first > max(0, low - 2 * MARGIN) and text[first - 1].isspace():
        first -= 1
    s = np.full(high - low + 1, NONE, np.int8)
    for level, pattern in _PATTERNS:
        ends = np.fromiter((m.end() for m in pattern.finditer(text, first, last)), np.int64)
        ends = ends[(ends >= low) & (ends <= high)] - low
        s[ends] = np.maximum(s[ends], level)
    for m in _ENTITY.finditer(text, max(0, low - 10), last):
        s[max(m.start() + 1 - low, 0) : max(m.end() - low, 0)] = TAG
    at = text.rfind("<", 0, low)
    if at < 0 or (closed := text.find(">", at)) < 0 or closed < low:
        at = text.find("<", low, high)
    while 0 <= at < high:
        following = text.find("<", at + 1)
        closed = text.find(">", at + 1, following if following >= 0 else len(text))
        if closed >= 0 and _OPENS.match(text, at):
            s[max(at + 1 - low, 0) : max(closed + 1 - low, 0)] = TAG
        at = following
    return s


class RangeMax:
    """Sparse table over strengths: the position of the largest value of a window, the rightmost of equals."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        level = np.arange(len(values), dtype=np.int32)
        self.levels = [level]
        width = 1
        while 2 * width <= min(longest, len(values)):
            a, b = level[: len(level) - width], level[width:]
            level = np.where(values[b] >= values[a], b, a)
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """The position within [low, high], both included."""
        k = (high - low + 1).bit_length() - 1
        a, b = int(self.levels[k][low]), int(self.levels[k][high - (1 << k) + 1])
        if self.values[a] == self.values[b]:
            return max(a, b)
        return a if self.values[a] > self.values[b] else b


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int | None = None) -> list[tuple[int, int]]:
    """The spans of the pieces. A piece but the last has ``least`` (half the limit) to ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    least = max(overlap + 1, limit // 2 if least is None else least)
    if len(text) <= limit:
        return [(0, len(text))]
    spans, start, table, base = [], 0, None, 0
    while len(text) - start > limit:
        if table is None or start + limit - base >= len(table.values):
            base = start
            table = RangeMax(strengths(text, base, min(base + STRETCH + limit, len(text))), limit - least + 1)
        cut = base + table.strongest(start + least - base, start + limit - base)
        spans.append((start, cut))
        start = cut - overlap
    return [*spans, (start, len(text))]


def split_texts(df: DataFrame, key: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, text, n_pieces): the pieces of each text, in order from 0.

    A row without text has no piece; repeated keys give repeated pieces; other columns of ``df`` are ignored.
    """
    cuts("", limit, overlap)
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    whole = rows.where(F.length("__text") <= limit).select(
        F.col("__key").alias(key), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("__text").alias("text"), F.lit(1).alias("n_pieces")
    )

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, found = [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            spans = cuts(t, limit, overlap)
            keys += [i] * len(spans)
            found += [(j, a, t[a:b], len(spans)) for j, (a, b) in enumerate(spans)]
        piece, start, texts, n = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int32())],
            ["__key", "piece", "start", "text", "n_pieces"],
        )

    long = rows.where(F.length("__text") > limit).mapInArrow(over_slices(cut, "__text", 1 << 22), f"__key {kind}, piece int, start bigint, text string, n_pieces int")
    return whole.unionByName(long.withColumnRenamed("__key", key))


def oversized(pieces: DataFrame, key: str) -> DataFrame:
    """The keys of the items that came out in more than one piece, once each."""
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(key).distinct()
