"""The languages of texts and of the segments of mixed texts, by a byte convolutional network.

A text, without its links, handles and tags, is cut at sentence ends into windows of at most 128 bytes. A network of
byte embeddings, filters of three widths, max pooling over the window and a softmax gives each window a language or
none (code, tables, strings without words). It is trained in numpy on windows of a bounded sample of labelled texts;
windows whose label the first passes contradict are left out of the later ones. The windows of a text are then read
once more in the light of the text as a whole, and counted by their letters.

Null and empty texts, and texts with fewer letters than asked, have no language. Repeated rows give repeated rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.arrowtext import byte_view, over_slices, slices
from corpusloom.llm.residue import sampled
from corpusloom.session import ship

WINDOW, EMBED, FILTERS = 128, 8, 16
#: Texts of the training sample for each table, the longest of them, and windows taken from all.
TRAIN_TEXTS, TRAIN_CHARS, TRAIN_WINDOWS = 3000, 4000, 32_000
#: Confidence that a further language of a text needs.
SURE = 0.7
#: Languages that the network knows; the last class is none.
LANGUAGES = ("en", "es", "de", "fr", "pt", "nl", "ru", "ja")
NONE = len(LANGUAGES)
#: Spellings of labels beyond a two-letter code with or without a region. Fixed values.
NAMES = {
    "en": "eng english englisch anglais inglés inglês engels английский 英語",
    "es": "spa spanish español espanol castellano spanisch espagnol espanhol spaans испанский スペイン語",
    "de": "deu ger german deutsch allemand alemán alemão duits немецкий ドイツ語",
    "fr": "fra fre french français francais französisch francés francês frans французский フランス語",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portugees португальский ポルトガル語",
    "nl": "nld dut dutch nederlands niederländisch néerlandais holandés holandês нидерландский オランダ語",
    "ru": "rus russian русский russisch russe ruso russo 露語 ロシア語",
    "ja": "jpn japanese 日本語 japanisch japonais japonés japonês japans японский",
}
#: Whether each code point up to the last plane that has letters is one.
_LETTER = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x32400)), bool, 0x32400)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 47, 63]] = True


def label(named: Column) -> Column:
    """The two-letter code that a label names, in any of its spellings; null if it names none of the known."""
    names = F.create_map(*(F.lit(x) for code, said in NAMES.items() for name in [code, *said.split()] for x in (name, code)))
    low = F.trim(F.lower(named))
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_extract(F.translate(low, "_", "-"), r"^([a-z]{2,3})-[a-z0-9-]+$", 1)))


def prose(text: Column) -> Column:
    """The text without links, handles and tags."""
    return F.when(text.rlike(r"[@#]|://"), F.regexp_replace(text, r"https?://\S+|[@#][\p{L}\p{N}_]+:?", " ")).otherwise(text)


@dataclass
class Windows:
    """Windows over texts that lie end to end: their bytes (padded with zeros), texts and letters."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    letters: np.ndarray

    def bytes_of(self, which: np.ndarray | slice) -> np.ndarray:
        start, size = self.start[which], self.size[which]
        place = np.arange(WINDOW)
        at = np.minimum(start[:, None] + place, len(self.data) - 1)
        return np.where(place < size[:, None], self.data[at], 0)


def letters_of(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 begin a letter, in any script."""
    if not len(data):
        return np.zeros(0, bool)
    out = (data < 128) & _LETTER[data & 127]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, after = data[lead].astype(np.int64), [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
        two, three, four = (first & 31) << 6 | after[0], (first & 15) << 12 | after[0] << 6 | after[1], (first & 7) << 18 | after[0] << 12 | after[1] << 6 | after[2]
        code = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
        out[lead] = (code < len(_LETTER)) & _LETTER[np.minimum(code, len(_LETTER) - 1)]
    return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> Windows:
    """Cut texts at sentence ends, and longer sentences evenly, into windows."""
    n = len(data)
    letter = letters_of(data)
    ends = _STOP[data]
    ends[:-1] &= (data[:-1] == 10) | ~_WORD[data[1:]]  # not the dots within a host name
    stop = np.flatnonzero(ends) + 1
    wide = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)) + 3 if n > 2 else stop[:0]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut = np.unique(np.concatenate([begin, stop, wide]))
    cut = cut[cut < n]
    total = np.concatenate([[0], np.cumsum(letter)])
    # a stretch of few letters joins the one before it, within its text
    got = total[np.append(cut[1:], n)] - total[cut]
    keep = (got >= 12) | np.isin(cut, begin, assume_unique=True)
    cut = cut[keep]
    end = np.append(cut[1:], n)
    parts = np.maximum(1, -(-(end - cut) // WINDOW))
    step = -(-(end - cut) // parts)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(cut, parts) + turn * np.repeat(step, parts)
    size = np.minimum(np.repeat(step, parts), np.repeat(end, parts) - start)
    good = size > 0
    start, size = start[good], size[good]
    text = np.searchsorted(offsets, start, side="right") - 1
    return Windows(data, start, size, text, total[start + size] - total[start])


@dataclass
class Network:
    """Embeddings of bytes; filters over one, two and three pairs of bytes; the last layer."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    #: What the last layer is divided by, so that confidences are as high as their hits are frequent.
    temper: float = 1.0
    report: dict = field(default_factory=dict)

    #: Columns of ``filters`` for the first, second and third pair of each width.
    WIDTHS = ((0,), (1, 2), (3, 4, 5))

    def forward(self, b: np.ndarray) -> tuple:
        n = len(b)
        x = self.embed[b].reshape(n, WINDOW // 2, 2 * EMBED)
        p = (x.reshape(-1, 2 * EMBED) @ self.filters).reshape(n, WINDOW // 2, -1)
        pooled, place = [], []
        for columns in self.WIDTHS:
            t = WINDOW // 2 - len(columns) + 1
            c = p[:, :t, columns[0] * FILTERS : (columns[0] + 1) * FILTERS]
            for i, k in enumerate(columns[1:], 1):
                c = c + p[:, i : i + t, k * FILTERS : (k + 1) * FILTERS]
            place.append(c)
            pooled.append(c.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        z = (h @ self.out + self.out_bias) / np.float32(self.temper)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), h, x, place

    def predict(self, w: Windows, batch: int = 128) -> np.ndarray:
        made = [self.forward(w.bytes_of(slice(i, i + batch)))[0] for i in range(0, len(w.start), batch)]
        return np.concatenate(made) if made else np.zeros((0, NONE + 1), np.float32)


def _new(rng: np.random.Generator) -> Network:
    make = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(make(256, EMBED, s=0.5), make(2 * EMBED, 6 * FILTERS, s=0.25), np.zeros(3 * FILTERS, np.float32), make(3 * FILTERS, NONE + 1, s=0.2), np.zeros(NONE + 1, np.float32))


def train(windows: np.ndarray, labels: np.ndarray, passes: int = 6, batch: int = 256, seed: int = 5) -> Network:
    """Adam on the cross-entropy; after two passes, windows that contradict their label are left out."""
    rng = np.random.default_rng(seed)
    net = _new(rng)
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = np.bincount(labels, minlength=NONE + 1) / max(1, len(labels))
    cost = (1 / np.maximum(share, 0.01))[labels] ** 0.5
    cost = (cost / cost.mean()).astype(np.float32) if len(cost) else cost
    kept, step = np.arange(len(labels)), 0
    for turn in range(passes):
        rng.shuffle(kept)
        doubted = []
        for i in range(0, len(kept), batch):
            rows = kept[i : i + batch]
            b, y = windows[rows], labels[rows]
            p, h, x, place = net.forward(b)
            if turn >= 1:
                doubted.append(rows[p[np.arange(len(y)), y] < 0.05])
            g = p.copy()
            g[np.arange(len(y)), y] -= 1
            g *= cost[rows, None] / len(y)
            gh = (g @ net.out.T) * (h > 0)
            gp = np.zeros((len(y), WINDOW // 2, 6 * FILTERS), np.float32)
            one, two = np.arange(len(y))[:, None], np.arange(FILTERS)
            for j, columns in enumerate(net.WIDTHS):
                at = place[j].argmax(1)
                for k, col in enumerate(columns):
                    gp[one, at + k, col * FILTERS + two] += gh[:, j * FILTERS : (j + 1) * FILTERS]
            flat = gp.reshape(-1, 6 * FILTERS)
            gx = (flat @ net.filters.T).reshape(-1, EMBED)
            ge = np.stack([np.bincount(b.ravel(), gx[:, e], 256) for e in range(EMBED)], 1)
            step += 1
            rate = 0.01 if turn < passes - 2 else 0.003
            for q, grad, (m, v) in zip(params, (ge, x.reshape(-1, 2 * EMBED).T @ flat, gh.sum(0), h.T @ g, g.sum(0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if turn >= 1 and doubted:
            kept = np.setdiff1d(kept, np.concatenate(doubted))
    return net


#: Words and marks of programming languages, for made windows of code. Fixed values.
KEYWORDS = (
    "if else elif for while do switch case default break continue return def class function func fn let var const static public private void int float bool string true false null None nil import from package use "
    "include try except catch finally throw raise new delete this self async await yield lambda match end begin select from where group by order join insert update set create table drop into values as and or not in is echo export sudo cat"
).split()
MARKS = "= == != <= >= + - * / % += && || -> => :: : ; , . ( ) [ ] { } < > # // $ @ ! ? | & ~ \\".split()


def spelled(text: bytes) -> np.ndarray:
    """How often each Latin letter (and the end of a word, 26) follows another in a text: 27 by 27 probabilities."""
    low = np.frombuffer(text.lower(), np.uint8).astype(np.int64) - 97
    low = np.where((low < 0) | (low > 25), 26, low)
    pair = low[:-1] * 27 + low[1:]
    held = np.bincount(pair, minlength=27 * 27).reshape(27, 27).astype(float)
    held[26, 26] = 0
    held += 0.5
    held[26, 26] = 0
    return held / held.sum(1, keepdims=True)


def wordless(n: int, letters: np.ndarray, seed: int = 3) -> list[bytes]:
    """Made windows without a language: random letters and digits, words that only follow the letters of the corpus, code, tables of numbers.

    ``letters`` says which letter follows which; names in code are made of the same letters.
    """
    rng = np.random.default_rng(seed)
    ends = np.cumsum(letters, axis=1)
    any_ = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", np.uint8)

    def word() -> bytes:
        """A pronounceable word, or letters at random."""
        if rng.random() < 0.3:
            return rng.choice(any_[:26], rng.integers(2, 12)).tobytes()
        made, at = [], 26
        while len(made) < 11:
            at = min(int(np.searchsorted(ends[at], rng.random())), 26)
            if at == 26:
                break
            made.append(97 + at)
        return bytes(made) or b"x"

    def name() -> bytes:
        parts = [word() for _ in range(rng.integers(1, 4))]
        return (b"_", b"", b".")[rng.integers(0, 3)].join(p.capitalize() if i and rng.random() < 0.3 else p for i, p in enumerate(parts))

    def number() -> bytes:
        whole = str(rng.integers(0, 10 ** int(rng.integers(1, 7)))).encode()
        return whole if rng.random() < 0.5 else whole + b"." + str(rng.integers(0, 1000)).encode()

    def token() -> bytes:
        kind = rng.random()
        return name() if kind < 0.4 else rng.choice(MARKS).encode() if kind < 0.7 else rng.choice(KEYWORDS).encode() if kind < 0.82 else number() if kind < 0.92 else b"'" + name() + b"'"

    def code() -> bytes:
        line = b"".join(t + (b" " if rng.random() < 0.6 else b"") for t in (token() for _ in range(rng.integers(2, 9))))
        return b"    " * int(rng.integers(0, 3)) + line

    kinds = (
        lambda: b" ".join(word() for _ in range(16)), lambda: b"\n".join(code() for _ in range(6)), lambda: b"\n".join(code() for _ in range(6)),
        lambda: rng.choice(any_, 120).tobytes(), lambda: b"\n".join(b"| " + b" | ".join(number() for _ in range(4)) + b" |" for _ in range(5)), lambda: b"\n".join(name() + b": " + number() for _ in range(8)),
    )
    return [kinds[rng.choice(6, p=[0.35, 0.2, 0.2, 0.1, 0.05, 0.1])]()[: rng.integers(40, WINDOW)] for _ in range(n)]


def fit(sources: list[tuple[DataFrame, str, str, str]], *, most: int = TRAIN_TEXTS, windows: int = TRAIN_WINDOWS) -> Network:
    """Train on (df, key, text, label) sources: at most ``most`` texts of each and ``windows`` windows of all."""
    got, codes = [], {c: i for i, c in enumerate(LANGUAGES)}
    for df, key, text, named in sources:
        known = df.select(F.col(key).alias("key"), F.col(text).alias("text"), label(F.col(named)).alias("label"))
        known = known.where(F.col("label").isNotNull() & (F.length("text").between(40, TRAIN_CHARS)))
        sample = sampled(known, "key", most).select(prose(F.col("text")).alias("text"), "label").toArrow()
        sample = sample.sort_by([("text", "ascending"), ("label", "ascending")])  # the same order in every run
        for batch in sample.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                w = windows_of(*byte_view(part.column(0)))
                own = np.array([codes[c] for c in part.column(1).to_pylist()])
                good = np.flatnonzero(w.letters >= 25)
                got.append((w.bytes_of(good), own[w.text[good]]))
    rng = np.random.default_rng(11)
    letters = spelled(b"\n".join(g[0][: windows // 4].tobytes() for g in got))
    made = [np.frombuffer(x.ljust(WINDOW, b"\0"), np.uint8) for x in wordless(windows // 10, letters)]
    x = np.concatenate([g[0] for g in got]) if got else np.zeros((0, WINDOW), np.uint8)
    y = np.concatenate([g[1] for g in got]) if got else np.zeros(0, int)
    pick = rng.permutation(len(y))[:windows]
    x, y = np.concatenate([x[pick], np.array(made, np.uint8)]), np.concatenate([y[pick], np.full(len(made), NONE)])
    test = rng.random(len(y)) < 0.1
    net = train(x[~test], y[~test].astype(np.int64))
    p = np.concatenate([net.forward(x[test][i : i + 256])[0] for i in range(0, test.sum(), 256)]) if test.any() else np.zeros((0, NONE + 1))
    net.report = {"windows": int((~test).sum()), "held out": int(test.sum()), "agreement with labels": float((p.argmax(1) == y[test]).mean()) if test.any() else 0.0}
    return calibrated(net, p, y[test])


def calibrated(net: Network, p: np.ndarray, y: np.ndarray) -> Network:
    """Set the temper by windows held out (probabilities ``p``, labels ``y``); labels that the network rules out count as wrong and are left out."""
    right = p[np.arange(len(y)), y] > 0.001
    p, y = p[right].astype(np.float64), y[right]
    if len(y) < 100:
        return net
    z = np.log(p + 1e-12)

    def tempered(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    def gap(q: np.ndarray) -> float:
        """The mean distance of confidence and hits over ten bins of confidence."""
        sure, hit = q.max(1), q.argmax(1) == y
        bins = np.minimum((sure * 10).astype(int), 9)
        return float(np.abs(np.bincount(bins, sure, 10) - np.bincount(bins, hit, 10)).sum() / len(y))

    net.temper = float(min(np.linspace(0.6, 3.0, 49), key=lambda t: -np.log(tempered(t)[np.arange(len(y)), y] + 1e-12).mean()))
    net.report |= {"temper": net.temper, "confidence against hits": {"before": gap(p), "after": gap(tempered(net.temper))}}
    return net


def _runs(which: np.ndarray, letters: np.ndarray, sure: np.ndarray) -> list[dict]:
    out, at = [], 0
    for k, n, s in zip(which.tolist(), letters.tolist(), sure.tolist(), strict=True):
        name = LANGUAGES[k] if k < NONE else None
        if out and out[-1]["lang"] == name:
            out[-1]["confidence"] = (out[-1]["confidence"] * out[-1]["letters"] + s * n) / max(1, out[-1]["letters"] + n)
            out[-1]["letters"] += n
        else:
            out.append({"at": at, "letters": n, "lang": name, "confidence": s})
        at += n
    return out


RESULT = "letters bigint, langs array<struct<lang:string,share:double,confidence:double>>, segments array<struct<at:bigint,letters:bigint,lang:string,confidence:double>>"
_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())]))
_SEGMENTS = pa.list_(pa.struct([("at", pa.int64()), ("letters", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))


def read(data: np.ndarray, offsets: np.ndarray, net: Network, share: float) -> tuple[np.ndarray, list, list]:
    """Letters, languages with at least ``share`` of them, and the segments of mixed texts."""
    n = len(offsets) - 1
    w = windows_of(data, offsets) if len(data) else Windows(data, *(np.zeros(0, np.int64) for _ in range(4)))
    p = net.predict(w).astype(np.float64)
    weight = w.letters.astype(np.float64)
    # the text as a whole weighs on each of its windows
    whole = np.stack([np.bincount(w.text, p[:, k] * weight, n) for k in range(NONE + 1)], 1)
    whole /= np.maximum(whole.sum(1, keepdims=True), 1e-9)
    p *= (whole + 1e-3)[w.text]
    p /= p.sum(1, keepdims=True)
    which = p.argmax(1)
    letters = np.bincount(w.text, w.letters, n).astype(np.int64)
    held = np.zeros((n, NONE + 1))
    sure = np.zeros((n, NONE + 1))
    np.add.at(held, (w.text, which), weight)
    np.add.at(sure, (w.text, which), weight * p[np.arange(len(which)), which])
    part = held / np.maximum(letters, 1)[:, None]
    langs, segments = [], []
    first = np.searchsorted(w.text, np.arange(n + 1))
    for i in range(n):
        found = [k for k in np.argsort(-part[i, :NONE], kind="stable") if part[i, k] >= share and part[i, k] > 0]
        found = [k for k in found if k == found[0] or sure[i, k] >= SURE * held[i, k]]
        langs.append([{"lang": LANGUAGES[k], "share": float(part[i, k]), "confidence": float(sure[i, k] / held[i, k])} for k in found])
        s = slice(first[i], first[i + 1])
        segments.append(_runs(which[s], w.letters[s], p[np.arange(s.start, s.stop), which[s]]) if len(found) > 1 else None)
    return letters, langs, segments


def identify(df: DataFrame, text: str, net: Network, keep: list[str], *, share: float = 0.15) -> DataFrame:
    """The kept columns with ``letters``, ``langs`` (largest first) and, for mixed texts, ``segments``."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(net)  # some 20 kB
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters, langs, segments = read(*byte_view(batch.column(0)), held.value, share)
        made = [pa.array(letters, pa.int64()), pa.array(langs, _LANGS), pa.array(segments, _SEGMENTS)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, "letters", "langs", "segments"])

    rows = df.select(prose(F.col(text)).alias("__text"), *keep)
    return rows.mapInArrow(over_slices(run, "__text", 1 << 19), f"{kinds}, {RESULT}")


def wrong(found: DataFrame, named: str, least: int = 40) -> DataFrame:
    """Of identified texts with at least ``least`` letters, those whose label is missing, wrong or one for several; exploded to ``lang``."""
    several = (F.size("langs") > 1) | ~F.coalesce(F.exists("langs", lambda x: x["lang"] == label(F.col(named))), F.lit(False))
    return found.where((F.col("letters") >= least) & (F.size("langs") > 0) & several).withColumn("lang", F.explode(F.transform("langs", lambda x: x["lang"])))
