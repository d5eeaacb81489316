"""Find documents whose page is template residue, filler, an error page or a demand for scripts.

A page is read as blocks (its lines without markup). A regularised linear classifier over hashed word n-grams, length
and title features and the likelihood of its letters scores every block. It is trained on weak labels in all
documents: general phrases, response statuses and blocks that say nothing. A large table is trained in slices by a hash
of the key, and the slices' weights are averaged, each by how often its feature occurs there. The labels spread to the other blocks of
a document that mostly consists of them, and from pass to pass to short pages that the model is sure of, so that it
learns wordings and languages that no phrase names. The hosts left out of all passes measure each, and choose the penalty.

A document is a case if the residue makes up most of its body, where words of menus and footers count for nothing and
a lone sentence doesn't save it; or if body is null or empty and error holds such text. Finished messages of the
extractor in error make no case. A document without body and error is none; repeated documents get one row each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrowtext import byte_view, mix, over_slices, prefix_hash, slices, span_hash
from corpusloom.llm.clean import visible
from corpusloom.session import discard, ship, stored

#: Documents and bytes of one slice in training (a longer document is cut nowhere), and bits of the feature space.
TRAIN_DOCS, TRAIN_BYTES, BITS = 4000, 16 << 20, 18
#: Passes of training, and the penalties of which the hosts left out choose one.
TURNS, PENALTIES = 4, (0.003, 0.01, 0.03)
#: Log-odds from which a block of a page of at most ``BRIEF`` bytes is residue (in a longer page: from 0 on), and from which a
#: page without a phrase becomes an example in the next pass.
CALLED, SURE, BRIEF = -1.5, -0.5, 400
#: A block shorter than this (bytes) that isn't residue counts as menu or heading; so long may a lone sentence be.
SHORT, LONE = 24, 240
#: What the extractor writes in error when it has ended in a known way. Fixed values.
FINISHED = (
    r"(?i)^\s*(?:thin extraction|rendered extraction was short|binary target|download is starting|target page, context or browser)"
    r"|net::err_|timeout \d+ ?ms exceeded"
)
#: What makes a block a weak example of residue, in general terms: placeholders of template languages, words for filler,
#: a demand for scripts, reason phrases of HTTP (RFC 9110) and statuses after the word error or http. Fixed values.
PLACEHOLDER = r"\{\{[^{}]*\}\}|[$#]\{[^{}]*\}|<%[-=]?|%\([a-z_.]+\)[sd]|@@\w+@@|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__|\[object object\]|\[insert [^\]]*\]|\[[A-Z][A-Z _]{3,}\]"
FILLER = r"\blorem\b|\bipsum\b|\bplaceholder (?:text|copy)|\bdummy text|\bsample text|\btext goes here"
SCRIPTS = r"(?:enable|allow|turn on|requires?|without) (?:java ?script|scripts|scripting)|(?:java ?script|scripts?) (?:is|are|must be) (?:disabled|required|off|enabled)|noscript"
STATUS = (
    r"\b(?:bad request|forbidden|not found|request timeout|too many requests|internal server error|bad gateway|service unavailable|gateway timeout)\b"
    r"|^\W*(?:http )?[45]\d\d\b|\b(?:error|http) ?[45]\d\d\b|^\W*traceback"
)
PHRASES = re.compile("|".join((PLACEHOLDER, FILLER, SCRIPTS, STATUS)), re.I)
#: A plain field in angle or curly brackets, or a word for a missing value; if they are a quarter of a block's words they count.
FIELD = re.compile(r"\{[a-z_.0-9]+\}|<[a-z_.]+>|\bXXXX\b|\bundefined\b|\bTBD\b|%[sd]\b")
#: What any block with a phrase or a field holds, far quicker to search for: the same patterns as Arrow reads them, wider where
#: the two differ (edges of words, digits and letters of other scripts, the two letters i without or with a dot that only Python folds).
HINT = "(?i)[\u0130\u0131]|" + re.sub(r"\\b", "", f"{PHRASES.pattern}|{FIELD.pattern}").replace(r"\W*", "[^a-z0-9_]*").replace(r"\d", r"\p{Nd}").replace(r"\w+", "[^@]+")
#: Text of letters typed at random: so far (in nats for each letter) under the usual likelihood of a block.
UNLIKELY = 1.0
#: Different words and pairs of words that a sample must have for its letters to say anything.
RICH = 5000
_A, _B, _TITLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEA] = True
_FLAT = np.where(_CLASS == 1, _LOWER, np.uint8(32))
#: The pair of two blanks.
_BLANKS = 32 * 256 + 32


@dataclass
class Blocks:
    """The blocks of some documents (the first of each is its title) and the hashed features in them."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    title: np.ndarray
    pipes: np.ndarray
    first: np.ndarray
    pairs: np.ndarray
    odd: np.ndarray
    words: np.ndarray
    repeats: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    docs: int


def _mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for bytes, in a fraction of the time."""
    return np.frombuffer(data.tobytes().translate(table.astype(np.uint8).tobytes()), table.dtype)


def letter_pairs(data: np.ndarray) -> np.ndarray:
    """For each byte the pair that it makes with the next one (other than letters and digits are blanks)."""
    low = np.append(_mapped(data, _FLAT), np.uint8(32)).astype(np.intp)
    return low[:-1] * 256 + low[1:]


def likelihood(pairs: np.ndarray) -> np.ndarray:
    """The log-probability of each letter after another, from counts of pairs."""
    held = pairs.reshape(256, 256) + 5.0  # so that a small sample calls no letter unlikely
    return np.log(held / held.sum(1, keepdims=True)).astype(np.float32).ravel()


def blocks_of(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, bits: int = BITS) -> Blocks:
    """Cut documents (bytes end to end, each "title newline text") into blocks and hash the n-grams of each.

    ``letters`` is the likelihood of pairs of letters above or below what is usual: four words and more of Latin letters in
    an unlikely order are ``odd``, like keys hit at random.
    """
    mask = np.uint64((1 << bits) - 1)
    start, end, kind, at, to, block = _cut(data, offsets)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    doc = np.searchsorted(offsets, start, side="right") - 1
    title = np.zeros(len(start), bool)
    title[np.searchsorted(start, begin)] = True
    prefix = prefix_hash(_mapped(data, _LOWER))
    word = span_hash(prefix, at, to)
    pair = np.flatnonzero(block[1:] == block[:-1])
    two = mix(word[pair] * _A + word[pair + 1])
    wide = np.flatnonzero(_mapped(data, _WIDE))
    inside = np.searchsorted(start, wide, side="right") - 1
    three = span_hash(prefix, wide, np.minimum(wide + 9, end[inside])) if len(wide) else np.zeros(0, np.uint64)
    # a word said twice is a feature of its own
    twice = pair[word[pair] == word[pair + 1]]
    runs = ((word, block), (two, block[pair]), (three, inside), (mix(np.full(len(twice), 3, np.uint64) * _B), block[twice]))
    held = [np.bincount(owner, minlength=len(start)) for _, owner in runs]
    count, words = sum(held), held[0]
    feature, free = np.empty(count.sum(), np.int32), np.cumsum(count) - count
    for (hashes, owner), n in zip(runs, held):  # the features of a block stand together, run after run
        titled = np.flatnonzero(title[owner])
        hashes[titled] = mix(hashes[titled] ^ _TITLE)
        feature[np.arange(len(owner)) + (free - (np.cumsum(n) - n))[owner]] = hashes & mask
        free += n
    likely = _likely(data, start, letters)
    latin, share = _tally(_mapped(data, _LATIN), start), np.maximum(end - start - _tally(kind == 0, start), 1)
    pipes = np.bincount(np.searchsorted(start, np.flatnonzero(data == 124), side="right") - 1, minlength=len(start))
    first = data[start] if len(data) else np.zeros(0, np.uint8)
    return Blocks(start, end, doc, title, pipes, first, likely, (words >= 4) & (latin > 0.9 * share) & (likely < -UNLIKELY), words, held[3], feature, count, len(offsets) - 1)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blocks of documents (start, end), the class of each byte, and the words (start, end, block)."""
    n, kind = len(data), _mapped(data, _CLASS)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = np.unique(np.concatenate([begin, np.flatnonzero(data == 10) + 1]))
    start = start[start < n]
    end = np.append(start[1:], n)
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[start] = True
    at = np.flatnonzero(edge)
    to = np.append(at[1:], n)
    held = kind[at] != 0
    at, to = at[held], to[held]
    return start, end, kind, at, to, np.repeat(np.arange(len(start)), np.diff(np.searchsorted(at, start), append=len(at)))


def _tally(marks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many bytes of each block are marked."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), np.append(start, len(marks))))


def _likely(data: np.ndarray, start: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The mean of ``letters`` over the pairs of each block that aren't two blanks."""
    told, worth = letter_pairs(data), letters.astype(np.float64)
    worth[_BLANKS] = 0
    counted = np.diff(np.append(start, len(data))) - _tally(told == _BLANKS, start)
    return (np.add.reduceat(worth[told], start) if len(start) else np.zeros(0)) / np.maximum(counted, 1)


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sums of runs of ``count`` values each."""
    total, held = np.zeros(len(count)), np.flatnonzero(count)
    if len(held):
        total[held] = np.add.reduceat(values, (np.cumsum(count) - count)[held])
    return total


#: Width of the dense part: 16 length buckets of the block, 16 of the document, no title, letters in unlikely order.
DENSE = 34


def _dense(b: Blocks, n_docs: int) -> np.ndarray:
    """Columns of the dense features that are 1 for each block."""
    size = b.end - b.start
    whole = np.bincount(b.doc, size, n_docs)
    untitled = np.zeros(n_docs, bool)
    untitled[b.doc[b.title]] = (size <= 1)[b.title]
    length = np.minimum(np.log2(size + 1).astype(int), 15)
    return np.stack([length, 16 + np.minimum(np.log2(whole[b.doc] + 1).astype(int), 15), np.where(untitled[b.doc], 32, -1), np.where(b.odd, 33, -1)], 1)


def scores(b: Blocks, n_docs: int, weights: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of each block, and what its own words say; its document's title counts a little for every block."""
    own = _sums(weights.astype(np.float64)[b.feature], b.count) / np.sqrt(np.maximum(b.count, 1))
    said = np.zeros(n_docs)
    said[b.doc[b.title]] = own[b.title]
    columns = _dense(b, n_docs)
    return own + np.where(b.title, 0, said[b.doc]) + np.where(columns >= 0, dense[columns], 0).sum(1), own


def train(b: Blocks, n_docs: int, label: np.ndarray, penalties: tuple[float, ...], rounds: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fit hashed and dense weights to the blocks with label 0 or 1 (-1: unused) by Adam on the logistic loss, once for each penalty, which pulls the weights towards 0 in each round, the few dense ones a tenth of it."""
    used, titles = np.flatnonzero((label >= 0) & ~b.title), np.flatnonzero(b.title)
    if not len(used):
        return [(np.zeros(1 << BITS, np.float32), np.zeros(DENSE, np.float32)) for _ in penalties]
    y, doc, titled = label[used].astype(np.float32), b.doc[used], b.doc[titles]
    share = max(float(y.mean()), 1e-3)
    cost = np.where(y > 0, min(3.0, ((1 - share) / share) ** 0.5), 1.0) / len(used)
    begin = np.cumsum(b.count) - b.count
    rows = np.concatenate([used, titles])
    count = b.count[rows]
    owner = np.repeat(np.arange(len(rows)), count)
    feature = b.feature[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[rows], count)].astype(np.int64)
    # rows sum their features as they stand, features their rows in an order of their own: both without scattered writes
    order = np.sort(feature << 32 | owner)
    sorted_, by = order >> 32, order & 0xFFFFFFFF
    of = np.flatnonzero(np.diff(sorted_, prepend=-1))
    known, often = sorted_[of], np.diff(of, append=len(sorted_))  # only the features that occur have weights to learn
    place = np.zeros(1 << BITS, np.int64)
    place[known] = np.arange(len(known))
    feature, buffer = place[feature], np.empty(len(feature))
    scale = 1 / np.sqrt(np.maximum(count, 1))
    columns = [c % (DENSE + 1) for c in _dense(b, n_docs)[used].T]  # what a block lacks is the last one, which stays 0
    fits = []
    for penalty in penalties:
        weights, dense = np.zeros(len(known), np.float32), np.zeros(DENSE + 1, np.float32)
        moments = [np.zeros_like(x) for x in (weights, weights, dense, dense)]
        for step in range(1, rounds + 1):
            own = _sums(np.take(weights.astype(np.float64), feature, out=buffer, mode="clip"), count) * scale
            said = np.zeros(n_docs)
            said[titled] = own[len(used) :]
            z = own[: len(used)] + said[doc] + sum(dense[c] for c in columns)
            g = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            per = np.concatenate([g, np.bincount(doc, g, n_docs)[titled]]) * scale
            gw = _sums(np.take(per, by, out=buffer, mode="clip"), often)
            gd = sum(np.bincount(c, g, DENSE + 1) for c in columns)
            gd[DENSE] = 0
            for x, grad, m, v, pull in ((weights, gw, *moments[:2], penalty), (dense, gd, *moments[2:], penalty / 10)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x *= np.float32(1 - pull)
                x -= (0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        whole = np.zeros(1 << BITS, np.float32)
        whole[known] = weights
        fits.append((whole, dense[:DENSE]))
    return fits


def shares(b: Blocks, n_docs: int, residue: np.ndarray) -> np.ndarray:
    """Whether residue makes up most of each document: menus don't count, a lone sentence doesn't either."""
    size = b.end - b.start
    menu = (b.pipes > 0) & (size < SHORT * (b.pipes + 1)) & (b.first != 124)
    bad = residue & ~b.title & (size > 1)
    rest = ~bad & ~b.title & (size >= SHORT) & ~menu
    bad_size, rest_size = np.bincount(b.doc, size * bad, n_docs), np.bincount(b.doc, size * rest, n_docs)
    lone = (np.bincount(b.doc, rest, n_docs) <= 1) & (rest_size <= LONE)
    return (bad_size > 0) & ((bad_size > rest_size) | lone)


def called(b: Blocks, n_docs: int, z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The documents that are cases by the log-odds of their blocks. In a longer page length alone makes no residue: the words must say so, or be no words."""
    size = b.end - b.start
    whole = np.bincount(b.doc[~b.title], size[~b.title], n_docs)
    brief = (whole <= BRIEF)[b.doc]
    return shares(b, n_docs, np.where(brief, z > CALLED, (z > 0) & ((own > 0) | b.odd)))


def _pages(df: DataFrame, key: str) -> DataFrame:
    """__key, __error (whether the text is that of error), __text ("title newline text"), url of documents that may be cases."""
    empty = F.col("body").isNull() | (F.length(F.trim("body")) == 0)
    said = F.when(F.col("error").rlike(FINISHED), None).otherwise(F.translate(F.regexp_replace("error", r"^Page\.goto: ", ""), "\n", " "))
    text = F.when(empty, said).otherwise(visible(F.col("body"), menus=False))
    # the rows are told by the plain columns: a test of the made text would make it twice
    return df.where(F.when(empty, said.isNotNull()).otherwise(F.lit(True))).select(
        F.col(key).alias("__key"), empty.alias("__error"), F.col("url").alias("__url"),
        F.concat(F.translate(F.coalesce("title", F.lit("")), "\n", " "), F.lit("\n"), text).alias("__text"),
    )


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    letters: np.ndarray
    report: dict


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` (at most 1.2 times as many), spread evenly by a hash of the key: for training only."""
    count = df.count()
    if count <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / count)).limit(most * 6 // 5)


def _host(url: str | None) -> str:
    return (url or "").split("//")[-1].split("/")[0]


def pair_counts(part: pa.RecordBatch) -> np.ndarray:
    counts = np.bincount(letter_pairs(byte_view(part.column(0))[0]), minlength=1 << 16).astype(np.float64)
    counts[_BLANKS] = 0
    return counts


def usual(b: Blocks) -> float:
    """The median likelihood of the blocks that hold words."""
    known = b.pairs[(b.end - b.start >= SHORT) & (b.words >= 4)]
    return float(np.median(known)) if len(known) else 0.0


def phrased(data: np.ndarray, b: Blocks) -> list[bool]:
    """Whether each block holds a phrase, or consists of fields."""
    held = pa.LargeStringArray.from_buffers(len(b.start), pa.py_buffer(np.append(b.start, len(data)).astype(np.int64)), pa.py_buffer(data))
    hits, likely = [False] * len(b.start), pc.match_substring_regex(held, HINT).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(likely).tolist():
        block = held[i].as_py()
        hits[i] = bool(PHRASES.search(block)) or len(FIELD.findall(block)) * 4 > len(block.split())
    return hits


def learn(sample: pa.Table, letters: np.ndarray | None = None) -> Model:
    """The model from pages (__text, __url, __error). A fifth of the hosts takes part in no pass; they measure each and choose the penalty.

    ``letters``: their likelihood in the whole corpus, above or below what is usual, if these are not all of its pages.
    """
    n, report = sample.num_rows, {"documents": sample.num_rows, "passes": []}
    parts = [p for batch in sample.combine_chunks().to_batches() for p in slices(batch, "__text")]
    made, hits = [], []
    if letters is None:
        letters = likelihood(sum((pair_counts(part) for part in parts), np.zeros(1 << 16)))
        first = [blocks_of(*byte_view(part.column(0)), letters) for part in parts]
        rich = len(np.unique(np.concatenate([p.feature for p in first]))) >= RICH
        letters = letters - np.float32(np.median([usual(p) for p in first])) if rich else np.zeros_like(letters)
    for part in parts:
        data, offsets = byte_view(part.column(0))
        made.append(blocks_of(data, offsets, letters))
        hits += phrased(data, made[-1])
        made[-1].doc += sum(p.docs for p in made[:-1])
        made[-1].docs = part.num_rows
    b = Blocks(*(np.concatenate([getattr(p, f.name) for p in made]) for f in fields(Blocks) if f.name != "docs"), n)
    size = b.end - b.start
    whole = np.bincount(b.doc[~b.title], size[~b.title], n)
    hit = np.array(hits) | b.odd | (b.repeats >= 4) & (b.repeats * 2 > b.words)  # phrases, or nothing said
    from_error = np.asarray(sample.column("__error").to_pylist())
    test = np.array([hash_of(_host(u)) % 5 == 0 for u in sample.column("__url").to_pylist()])
    weak = shares(b, n, hit)
    bad = np.bincount(b.doc, size * (hit & ~b.title), n)
    clear = ~weak & ~from_error & (((bad == 0) & (whole >= 200)) | (bad < 0.2 * whole))
    case, kept, penalty = weak.copy(), hash_blocks(b) % 3 == 0, PENALTIES[0]  # of clear documents a third of the blocks will do
    judged = test & (weak | clear)
    for turn in range(TURNS):
        label = np.where(case[b.doc], 1, np.where(clear[b.doc] & kept, 0, -1))
        label[(label == 1) & (size < SHORT) & ~hit] = -1
        label[test[b.doc]] = -1
        fits = []
        tried = PENALTIES if turn == 0 else (penalty,)
        for p, (weights, dense) in zip(tried, train(b, n, label, tried)):
            z, own = scores(b, n, weights, dense)
            seen = judged[b.doc] & ~b.title & (size >= SHORT)
            loss = np.logaddexp(0, np.where(weak[b.doc], -z, z))[seen]
            fits.append((float(loss.mean()) if len(loss) else 0.0, p, weights, dense, z, own))
        _, penalty, weights, dense, z, own = min(fits, key=lambda f: f[:2])
        found = called(b, n, z, own)
        right = int((found & weak & judged).sum())
        report["passes"].append({"right": right, "found": int((found & judged).sum()), "weak": int((weak & judged).sum()), "precision": right / max(1, int((found & judged).sum())), "recall": right / max(1, int((weak & judged).sum())), "documents": int(judged.sum())})
        sure = shares(b, n, z > SURE)
        case, clear = case | (sure & ~clear), clear & ~found
    beyond = found & ~weak
    counts = np.bincount(b.feature, minlength=1 << BITS) * (weights != 0)
    return Model(weights, dense, letters, report | {"counts": counts.astype(np.float32), "penalty": penalty, "weak cases": int(weak.sum()), "cases": int(found.sum()), "beyond the phrases": float(beyond.sum() / max(1, found.sum()))})


#: How many sums a task adds at a time, and how many the driver gets at most.
FAN, LAST = 16, 8


def _summed(df: DataFrame, f: Callable[[pa.Table], np.ndarray], parts: int) -> np.ndarray:
    """The sum over all ``parts`` slices of what ``f`` makes of each: summed on the executors in as many steps as it takes, in the same order in every run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([whole.column("__slice")[:1].combine_chunks(), pa.array([f(whole.drop_columns(["__slice"])).tobytes()], pa.binary())], ["slice", "sums"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("__slice")).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, z in zip(edges, edges[1:]):
                if held and z > a and held[-1].column("__slice")[0].as_py() != of[a]:
                    yield made(held)
                    held = []
                if z > a:
                    held.append(batch.slice(a, z - a))
        if held:
            yield made(held)

    def added(kind: type) -> Callable[[pa.Table], pa.Table]:
        def add(table: pa.Table) -> pa.Table:
            of = table.column("slice").to_numpy()
            total = sum(np.frombuffer(table.column("sums")[int(i)].as_py(), kind).astype(np.float64) for i in np.argsort(of, kind="stable"))
            return pa.table({"slice": pa.array([int(of.min())]), "sums": pa.array([total.tobytes()], pa.binary())})

        return add

    sums, kind = df.mapInArrow(each, "slice bigint, sums binary"), np.float32
    while parts > LAST:
        parts = -(-parts // FAN)
        sums, kind = sums.groupBy(F.pmod("slice", F.lit(parts))).applyInArrow(added(kind), "slice bigint, sums binary"), np.float64
    rows = sorted((r["slice"], r["sums"]) for r in sums.collect())  # at most ``LAST`` rows of bounded size
    return sum(np.frombuffer(r[1], kind).astype(np.float64) for r in rows)


def _parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return (p for batch in table.combine_chunks().to_batches() for p in slices(batch, "__text"))


#: Steps (in nats) of the table of blocks' likelihoods, of which the median is taken, and their number.
STEP, STEPS = 0.001, 20_000


def _mixed(pages: DataFrame, parts: int) -> Model:
    """The model from all ``parts`` slices of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast
    counts = _summed(pages, lambda t: sum((pair_counts(p) for p in _parts(t)), np.zeros(1 << 16)).astype(np.float32), parts)
    letters = likelihood(counts)
    known = held(letters)

    def spread(table: pa.Table) -> np.ndarray:
        total, seen = np.zeros(STEPS), np.zeros(1 << BITS)
        for part in _parts(table):
            data, offsets = byte_view(part.column(0))
            if np.count_nonzero(seen) < RICH:  # one rich slice makes the whole rich: no more features need to be told apart
                seen[blocks_of(data, offsets, known.value).feature] = 1
            start, end, _, _, _, block = _cut(data, offsets)
            held = (end - start >= SHORT) & (np.bincount(block, minlength=len(start)) >= 4)
            total += np.bincount(np.clip(-_likely(data, start, known.value)[held] / STEP, 0, STEPS - 1).astype(int), minlength=STEPS)
        return np.concatenate([total, seen]).astype(np.float32)

    total, seen = np.split(_summed(pages, spread, parts), [STEPS])
    total = np.cumsum(total)
    known = held(letters + np.float32(STEP * (0.5 + np.searchsorted(total, total[-1] / 2))) if np.count_nonzero(seen) >= RICH else np.zeros_like(letters))

    def taught(table: pa.Table) -> np.ndarray:
        m = learn(table, known.value)
        n, told = m.report["counts"], table.num_rows * (m.dense != 0)
        figures = [m.report[c] for c in ("documents", "weak cases", "cases")] + [m.report["beyond the phrases"] * m.report["cases"]]
        measured = [p[c] for p in m.report["passes"] for c in ("right", "found", "weak")]
        return np.concatenate([n * m.weights, n, told * m.dense, told, figures, measured]).astype(np.float32)

    all_ = _summed(pages, taught, parts)
    w, n, d, told, figures, measured = np.split(all_, np.cumsum([1 << BITS, 1 << BITS, DENSE, DENSE, 4]))
    passes = [{"precision": float(r / max(1, f)), "recall": float(r / max(1, k))} for r, f, k in measured.reshape(-1, 3)]
    report = {"documents": int(figures[0]), "passes": passes, "weak cases": int(figures[1]), "cases": int(figures[2]), "beyond the phrases": float(figures[3] / max(1, figures[2]))}
    return Model((w / np.maximum(n, 1)).astype(np.float32), (d / np.maximum(told, 1)).astype(np.float32), known.value, report)


def fit(df: DataFrame, key: str = "doc_id", *, most: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> Model:
    """Train on all documents, in slices of about ``most`` documents and ``longest`` bytes by a hash of the key."""
    model, made = _fitted(df, key, most, longest)
    if made is not None:
        discard(made)
    return model


def _fitted(df: DataFrame, key: str, most: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> tuple[Model, DataFrame | None]:
    """The model, and the stored pages it was trained on if they are several slices."""
    ship(df.sparkSession)
    size = F.coalesce(F.octet_length("body"), F.lit(0)) + F.coalesce(F.octet_length("error"), F.lit(0))
    count, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-count // most), -(-held // longest))
    order = [("__text", "ascending"), ("__url", "ascending")]  # the same order in every run
    pages = _pages(df, key)
    if parts == 1:
        sample = pages.select("__text", "__url", "__error").toArrow().sort_by(order)
        if not sample.num_rows:
            return Model(np.zeros(1 << BITS, np.float32), np.zeros(DENSE, np.float32), likelihood(np.zeros(1 << 16)), {"documents": 0}), None
        return learn(sample), None
    cut = pages.repartition(parts, F.xxhash64("__key")).withColumn("__slice", F.spark_partition_id().cast("bigint"))
    made = stored(cut.sortWithinPartitions("__text", "__url").select("__text", "__url", "__error", "__slice", "__key"), "pages")
    return _mixed(made.drop("__key"), parts), made


def hash_blocks(b: Blocks) -> np.ndarray:
    return mix(np.arange(len(b.start), dtype=np.uint64) + np.uint64(1)) >> np.uint64(8)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def judge(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Whether each document is a case."""
    b = blocks_of(data, offsets, model.letters)
    return called(b, b.docs, *scores(b, b.docs, model.weights, model.dense))


def find(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """The keys of the documents that are cases."""
    return _found(_pages(df, key), model, key)


def _found(pages: DataFrame, model: Model, key: str) -> DataFrame:
    ship(pages.sparkSession)
    kind = pages.schema["__key"].dataType.simpleString()
    halves = Model(model.weights.astype(np.float16), model.dense, model.letters.astype(np.float16), {})
    held = pages.sparkSession.sparkContext.broadcast(halves)  # less than a megabyte, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        whole = Model(h.weights.astype(np.float32), h.dense, h.letters.astype(np.float32), {})
        yield from over_slices(lambda part: part.select([0]).filter(pa.array(judge(*byte_view(part.column(1)), whole))), "__text")(batches)

    rows = pages.select("__key", "__text")
    return rows.mapInArrow(score, f"__key {kind}").withColumnRenamed("__key", key)


def cases(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fit on all of ``df`` and find the cases in it."""
    model, made = _fitted(df, key)
    if made is None:
        return find(df, model, key)
    found = stored(_found(made, model, key), "residue")
    discard(made)
    return found
