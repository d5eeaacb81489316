"""How demanding a text is to read: boosted regression trees over features of its words and sentences.

Features are the distributions of word lengths and syllables, vocabulary, sentence lengths, punctuation within
sentences and the cohesion of neighbouring sentences. The trees learn a school grade: where sentences can be told
apart, the consensus of four public readability formulas, which know words by their syllables, letters or share of long or short ones,
gives the target, and every training text is seen a second time without its sentence features, so that texts without
punctuation (transcripts) are graded by their words. Grades are calibrated on
predictions for sources that were held out, one after the other.

Null and empty texts have no words and no grade. Repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrowtext import byte_view, over_slices, prefix_hash, slices, span_hash
from corpusloom.llm.language import letters_of
from corpusloom.llm.residue import sampled
from corpusloom.session import ship

#: Texts of the training sample and the longest of them in characters; trees, their depth and step; bins of a feature.
TRAIN_TEXTS, TRAIN_CHARS, TREES, DEPTH, STEP, BINS = 3000, 20_000, 80, 3, 0.12, 48
#: Below the first grade a text is easy (to the sixth year); from the second on, where college ends, it is hard.
EASY, HARD = 7.0, 15.5
#: Words in a sentence beyond which its end marks can't be trusted.
LONGEST_SENTENCE = 60
FUNCTION_WORDS = "the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not what all were we when your can said there".split()  # fixed values
FEATURES = (
    "words", "word length", "word length spread", "up to 3 letters", "4 to 5 letters", "6 to 8 letters", "9 to 12 letters", "13 letters or more",
    "syllables", "3 syllables or more", "distinct", "function words", "sentence length", "sentence length spread", "inner marks", "cohesion", "1 syllable",
)
#: The features that need sentences.
BY_SENTENCE = (12, 13, 14, 15)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_VOWEL = np.zeros(256, bool)
_VOWEL[np.frombuffer(b"aeiouyAEIOUY", np.uint8)] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of the bytes end to end; -1 where sentences can't be told apart."""
    n, size = len(offsets) - 1, len(data)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not size:
        return out
    begins = letters_of(data)
    lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(size), 0))
    kind = begins[lead].astype(np.uint8)  # the further bytes of a letter belong to it
    alone = kind.copy()
    kind[1:-1] |= (data[1:-1] == 39) & (kind[:-2] == 1) & (kind[2:] == 1)
    edge = np.ones(size, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < size]] = True
    at = np.flatnonzero(edge)
    to = np.append(at[1:], size)
    digit = _DIGIT[data]
    held = (kind[at] == 1) & ~(digit[np.maximum(at - 1, 0)] & (at > 0)) & ~(digit[np.minimum(to, size - 1)] & (to < size))  # no parts of numbers and keys
    at, to = at[held], to[held]
    if not len(at):
        return out
    text = np.searchsorted(offsets, at, side="right") - 1
    written = np.concatenate([[0], np.cumsum(begins)])
    letters = written[to] - written[at]
    vowel = _VOWEL[data]
    group = vowel.copy()
    group[1:] &= ~vowel[:-1]
    total = np.concatenate([[0], np.cumsum(group)])
    beats = total[to] - total[at] + (vowel[at] & ~group[at])
    beats -= (_LOW[data[to - 1]] == 101) & (beats > 1) & ~vowel[np.maximum(to - 2, 0)]
    beats = np.maximum(beats, 1)
    words = np.bincount(text, minlength=n)
    per = lambda x: np.bincount(text, x, n) / np.maximum(words, 1)
    word = span_hash(prefix_hash(_LOW[data]), at, to)
    order = np.lexsort((word, text))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1])
    known = np.frombuffer("".join(FUNCTION_WORDS).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in FUNCTION_WORDS])
    function = span_hash(prefix_hash(known), ends - [len(w) for w in FUNCTION_WORDS], ends)
    out[:, 0] = np.log1p(words)
    out[:, 1] = per(letters)
    out[:, 2] = np.sqrt(np.maximum(per(letters.astype(float) ** 2) - out[:, 1].astype(float) ** 2, 0))
    for i, (low, high) in enumerate(((0, 3), (4, 5), (6, 8), (9, 12), (13, 1 << 30))):
        out[:, 3 + i] = per((letters >= low) & (letters <= high))
    out[:, 8], out[:, 9] = per(beats), per(beats >= 3)
    out[:, 16] = per(beats == 1)
    out[:, 10] = np.bincount(text[order], fresh, n) / np.sqrt(np.maximum(words, 1))
    out[:, 11] = per(np.isin(word, function))
    # sentences: from one end mark to the next
    mark = np.isin(data, np.frombuffer(b".!?", np.uint8))
    mark[:-1] &= ~(alone[1:] == 1) & ~digit[1:]
    sentence = np.concatenate([[0], np.cumsum(mark)])[at]
    sentence = sentence + text  # a text ends its sentence
    length = np.bincount(sentence)
    owner = np.zeros(len(length), np.int64)
    owner[sentence] = text
    real = length > 0
    count = np.bincount(owner[real], minlength=n)
    mean = words / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(owner[real], length[real].astype(float) ** 2, n) / np.maximum(count, 1) - mean**2, 0))
    inner = np.flatnonzero(np.isin(data, np.frombuffer(b",;:", np.uint8)))
    inner = np.bincount(np.searchsorted(offsets, inner, side="right") - 1, minlength=n)
    long = np.flatnonzero(letters >= 5)
    mine = np.unique(np.stack([sentence[long].astype(np.uint64), word[long]], 1), axis=0) if len(long) else np.zeros((0, 2), np.uint64)
    blend = lambda s, w: w ^ (s * np.uint64(0x9E3779B97F4A7C15))
    here, before = blend(mine[:, 0], mine[:, 1]), blend(mine[:, 0] - np.uint64(1), mine[:, 1])
    again = np.isin(before, here)
    whose = owner[mine[:, 0].astype(np.int64)]
    out[:, 12], out[:, 13] = mean, spread
    out[:, 14] = inner / np.maximum(count, 1)
    out[:, 15] = np.bincount(whose, again, n) / np.maximum(np.bincount(whose, minlength=n), 1)
    out[np.ix_(mean > LONGEST_SENTENCE, BY_SENTENCE)] = -1
    return out


def formulas(x: np.ndarray) -> dict[str, np.ndarray]:
    """School grades of texts with sentences by public formulas, each of which knows words by something else."""
    length = np.maximum(x[:, 12], 1)
    return {
        "Flesch-Kincaid: syllables, sentences": 0.39 * length + 11.8 * x[:, 8] - 15.59,
        "Coleman-Liau: letters, sentences": 5.88 * x[:, 1] - 29.6 / length - 15.8,
        "Gunning Fog: long words, sentences": 0.4 * (length + 100 * x[:, 9]),
        "FORCAST: words of one syllable": 20 - 15 * x[:, 16],
    }


def consensus(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean of the formulas, each brought to the mean and spread of the first over these texts, and how well they agree (mean correlation of two)."""
    grades = list(formulas(x).values())
    if len(x) < 2:
        return grades[0], 1.0
    mean, spread = grades[0].mean(), grades[0].std()
    alike = [(g - g.mean()) / max(g.std(), 1e-6) * spread + mean for g in grades]
    pairs = np.corrcoef(alike)[np.triu_indices(len(alike), 1)] if all(g.std() > 1e-6 for g in grades) else np.ones(1)
    return np.mean(alike, 0), float(pairs.mean())


@dataclass
class Trees:
    """Boosted trees of equal depth: the feature and threshold of each inner node, the value of each leaf."""

    base: float = 0.0
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    value: list = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    report: dict = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        y = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            y += value[node - (2**DEPTH - 1)]
        return y

    def grade(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.slope + self.shift


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Fit trees to the residuals one after the other, over binned features."""
    made = Trees(base=float(y.mean()) if len(y) else 0.0)
    if len(y) < 20:
        return made
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    left = y - made.base
    for _ in range(trees):
        inner = 2**DEPTH - 1
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = 0.0
            for f in range(1, x.shape[1]) if len(rows) >= 20 else ():  # the number of words says nothing about them
                b = binned[rows, f]
                n, s = np.bincount(b, minlength=BINS), np.bincount(b, left[rows], BINS)
                n, s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
                m, t = len(rows) - n, left[rows].sum() - s
                gain = np.where((n >= 8) & (m >= 8), s**2 / (n + 1) + t**2 / (m + 1), -1) - left[rows].sum() ** 2 / (len(rows) + 1)
                at = int(gain.argmax())
                if gain[at] > best and at < len(edges[f]):
                    best, feature[i], threshold[i] = gain[at], f, edges[f][at]
            node[rows] = 2 * i + 1 + (x[rows, feature[i]] > threshold[i])
        leaf = node - inner
        value = STEP * np.bincount(leaf, left, 2**DEPTH) / (np.bincount(leaf, minlength=2**DEPTH) + 1)
        left = left - value[leaf]
        made.feature.append(feature), made.threshold.append(threshold), made.value.append(value)
    return made


def fit(df: DataFrame, key: str, text: str, source: str, *, most: int = TRAIN_TEXTS) -> Trees:
    """Train on at most ``most`` texts of ``df`` (of one language), cross-validated and calibrated by ``source``."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    sample = sampled(rows.where(F.length("text").between(200, TRAIN_CHARS)), "key", most).select("text", "source").toArrow()
    sample = sample.sort_by([("text", "ascending"), ("source", "ascending")])  # the same order in every run
    parts = [features(*byte_view(p.column(0))) for b in sample.combine_chunks().to_batches() for p in slices(b, "text")]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
    told = x[:, 12] > 0
    sources = np.array([str(s) for s in sample.column(1).to_pylist()], object)[told]
    x = x[told]
    y, agree = consensus(x)
    y = np.clip(y, 0, 25)
    bare = x.copy()
    bare[:, BY_SENTENCE] = -1
    x, y, sources = np.concatenate([x, bare]), np.concatenate([y, y]), np.concatenate([sources, sources])
    held, errors = np.full(len(y), np.nan), {}
    for s in sorted(set(sources)):
        test = sources == s
        if test.all():
            continue
        held[test] = boost(x[~test], y[~test], TREES // 2).raw(x[test])
        errors[s] = float(np.sqrt(np.mean((held[test] - y[test]) ** 2)))
    made = boost(x, y)
    good = np.isfinite(held)
    if good.sum() > 50 and held[good].std() > 0.1:
        made.slope = float(np.clip(np.cov(held[good], y[good])[0, 1] / held[good].var(), 0.8, 1.2))
        made.shift = float(y[good].mean() - made.slope * held[good].mean())
    made.report = {"texts": len(y) // 2, "agreement of the formulas": agree, "error on held-out sources": errors}
    return made


def grade(df: DataFrame, text: str, trees: Trees, keep: list[str]) -> DataFrame:
    """The kept columns with ``grade`` (null without words) and ``band``."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(trees)  # some 20 kB
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*byte_view(batch.column(0)))
        made = pa.array(held.value.grade(x), pa.float64(), mask=x[:, 0] == 0)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*keep, "grade"])

    rows = df.select(F.col(text).cast("string").alias("__text"), *keep)
    graded = rows.mapInArrow(over_slices(run, "__text"), f"{kinds}, grade double")
    return graded.withColumn("band", F.when(F.col("grade") < EASY, "easy").when(F.col("grade") < HARD, "middle").when(F.col("grade").isNotNull(), "hard"))
