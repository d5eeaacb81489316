"""Near-duplicate records by DartMinHash signatures, banded joining and an exact check.

A record is the set of the distinct runs of ten characters of its normalised text. Every run throws hashed darts into
its region (weight by time): the arrival times of a Poisson process seeded by the run's hash, each with a hashed
coordinate. A signature keeps the earliest arrival of each coordinate; two records agree in a coordinate with the
probability of their (weighted) Jaccard similarity. Only darts earlier than a record's horizon are thrown, some
``k (ln k + 2)`` for a record of any size, so that long records cost one hash for each run and little more.

Exact copies are put into classes first. Representatives meet in bands of coordinates; met pairs must agree in a
small sketch, and those that do are compared exactly. Nothing is capped: a band or class that many records share is
spread over tasks by salt, and every pair in it is looked at. What can be lost is stated: a pair of similarity 0.5 meets
in no band with probability 0.08 (0.6: 0.004), and falls under the sketch's bound with less than 0.0001.

Null texts, and texts with fewer letters and digits than asked, are in no pair. A key that repeats counts once for
each different text. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.arrowtext import mix, over_slices, prefix_hash, span_hash
from corpusloom.llm.clean import visible
from corpusloom.session import discard, stored

RUN, BANDS, ROWS, SKETCH = 10, 40, 4, 64
#: Share of agreeing sketch coordinates below which a met pair can't reach the threshold (4 deviations under 0.5).
LEAST_AGREEMENT = 0.25
#: Keys that are broadcast at most (16 MB); more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Records of one band key that one task joins with one another.
BLOCK = 2000
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def normalised(text: Column) -> Column:
    """Letters and digits in lower case; markup, links and transcript marks removed."""
    plain = visible(text)
    plain = F.when(plain.contains("://"), F.regexp_replace(plain, r"(?i)https?://[^\s)\]>\"']*", "")).otherwise(plain)
    return F.lower(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", ""))


def runs(texts: list[str], size: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` characters, the number of them in each text, and a hash of each whole text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length)
    prefix = prefix_hash(codes)
    whole = span_hash(prefix, end - length, end)
    total, down = prefix
    n = max(0, len(codes) - size + 1)
    every = mix((total[size : size + n] - total[:n]) * down[:n])
    count = np.maximum(length - size + 1, 0)
    at = np.ones(len(codes), bool)
    for back in range(1, size):  # a run must end within its text
        at[np.maximum(end - back, end - length)] = False
    tiny = length < size
    for i in np.flatnonzero(tiny):
        at[end[i] - length[i] : end[i]] = False
    return every[at[:n]] if n else np.zeros(0, np.uint64), count, whole


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(hashes: np.ndarray, count: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The earliest arrival of each of ``k`` coordinates (float64, one row for each record).

    ``hashes`` are the elements' hashes, ``count`` the number of them in each record, ``weight`` their weights (1 if
    left out): an element of weight w owns ceil(w) unit regions, and of the last one a part. Repeats of an element
    change nothing. A record without elements has infinity everywhere.
    """
    owner = np.repeat(np.arange(len(count), dtype=np.int64), count)
    depth = None
    if weight is not None:
        layers = np.maximum(np.ceil(weight).astype(np.int64), 0)
        layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        depth = np.repeat(weight, layers) - layer
        owner, hashes = np.repeat(owner, layers), mix(np.repeat(hashes, layers) + layer.astype(np.uint64) * _D)
        count = np.bincount(owner, minlength=len(count))
    signature = np.full((len(count), k), np.inf)
    horizon = k * (np.log(k) + 2) / np.maximum(count, 1)
    open_ = count > 0
    while open_.any():
        signature[open_] = np.inf
        limit = np.where(open_, horizon, 0.0)
        first = np.flatnonzero(_unit(hashes) < -np.expm1(-limit)[owner])
        doc, seed = owner[first], hashes[first]
        part = depth[first] if depth is not None else None
        time, state = -np.log1p(-_unit(seed)), seed
        while len(doc):
            place = mix(state ^ _C)
            hit = slice(None) if part is None else _unit(mix(place + _D)) < part
            np.minimum.at(signature.reshape(-1), doc[hit] * k + (place[hit] % np.uint64(k)).astype(np.int64), time[hit])
            state = mix(state + _D)
            time = time - np.log1p(-_unit(state))
            on = time < limit[doc]
            doc, state, time = doc[on], state[on], time[on]
            part = part[on] if part is not None else None
        full = np.isfinite(signature).all(1)
        open_ = open_ & ~full
        horizon = horizon * 3
    return signature


def jaccard(a: str, b: str, size: int = RUN) -> float:
    """The exact share of distinct runs."""
    h, count, _ = runs([a, b], size)
    x, y = np.unique(h[: count[0]]), np.unique(h[count[0] :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    hashes, count, whole = runs(texts)
    s = signatures(hashes, count, BANDS * ROWS)
    bits = mix(s.view(np.uint64))
    keys = bits[:, 0::ROWS].copy()
    for r in range(1, ROWS):
        keys = mix(keys * _C + bits[:, r::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _D)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
    sketch = np.ascontiguousarray((bits[:, :SKETCH] & np.uint64(255)).astype(np.uint8))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))), pa.array([row.tobytes() for row in sketch], pa.binary())],
        ["key", "whole", "bands", "sketch"],
    )


def signed(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, whole, bands, sketch) of each record with at least ``least`` letters and digits; ``whole`` names its text."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        # here, since a test of the made text in the plan would make it twice
        long = batch.filter(pc.greater_equal(pc.utf8_length(batch.column(1)), least))
        return _sign(long) if long.num_rows else None

    rows = df.where((F.length(text) >= least) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), normalised(F.col(text)).alias("text"))
    return rows.mapInArrow(over_slices(sign, "text", 1 << 19), "key bigint, whole bigint, bands array<bigint>, sketch binary")


def within(rows: DataFrame, group: str, key: str, spare: list[DataFrame]) -> DataFrame:
    """Distinct (a, b), a < b, of the keys that share a group; a crowded group is joined block by block, so that no task holds it.

    Stored tables that the result reads are added to ``spare``, to be discarded when it has been written.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("key"))
    crowd = stored(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    rows = stored(rows.join(crowd, "g").select("g", "key", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks")), "met")
    discard(crowd)
    spare.append(rows)
    # block i meets block j at the place (min, max); with one block a row is in one place only
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("g", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    x, y = placed.alias("x"), placed.alias("y")
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    apart = (F.col("x.p") == F.col("x.q")) | (F.col("x.own") != F.col("y.own"))
    return x.join(y, same & apart & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def met(representatives: DataFrame, spare: list[DataFrame]) -> DataFrame:
    """Distinct (a, b), a < b, of representatives that share a band."""
    return within(representatives.select("key", F.explode("bands").alias("band")), "band", "key", spare)


def _agree(batch: pa.RecordBatch) -> pa.RecordBatch:
    x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
    return batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT))


def _few(keys: DataFrame) -> DataFrame:
    """Broadcast the keys if they are few, after counting them; else leave them to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def similar(df: DataFrame, key: str, text: str, *, least: int, threshold: float = 0.5, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and similar pairs (a, b, similarity) of classes, a < b.

    A class is a set of records with equal normalised texts, named by its smallest key. ``without`` holds keys that
    take no part.
    """
    items = signed(df, key, text, least)
    if without is not None:
        items = items.join(without.select(F.col(without.columns[0]).alias("key")).distinct(), "key", "left_anti")
    items = stored(items.dropDuplicates(["key", "whole"]), "signed")
    classes = items.groupBy("whole").agg(F.min("key").alias("class"))
    members = stored(items.select("key", "whole").join(classes, "whole").select("key", "class", "whole"), "members")
    named = members.where("key = class").select("key", "whole").distinct()
    standing = stored(items.join(named, ["key", "whole"]).select("key", "bands", "sketch"), "standing")
    discard(items)
    sketches = standing.select("key", "sketch")
    spare: list[DataFrame] = [standing]
    pairs = met(standing.select("key", "bands"), spare)
    pairs = pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    pairs = stored(pairs.mapInArrow(lambda it: map(_agree, it), "a bigint, b bigint"), "agreeing")
    discard(*spare)
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).join(_few(wanted), "key", "left_semi")
    texts = stored(source.select("key", normalised(F.col("text")).alias("text")).dropDuplicates(["key", "text"]), "texts")
    discard(wanted)

    def check(batches):
        for batch in batches:
            j = [jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array(np.array(j) >= threshold))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    found = both.mapInArrow(check, "a bigint, b bigint, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    found = stored(found, "similar")
    discard(pairs, texts)
    return members.select("key", "class").distinct(), found


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of keys, key_a < key_b: within a class, and across similar classes.

    A class of very many copies is spread by salt in both: block by block within itself, and a part at a time across.
    """
    members = stored(members, "copies")
    inner = within(members, "class", "key", [])
    crowded = _few(members.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = members.join(crowded, "class", "left").select("class", "key", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("part"))

    def side(rows: DataFrame, at: str, name: str) -> DataFrame:
        spread = rows.join(crowded.withColumnRenamed("class", at), at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        return spread.join(placed.select(F.col("class").alias(at), "part", F.col("key").alias(name)), [at, "part"]).drop("part")

    across = side(side(pairs.select("a", "b"), "a", "x"), "b", "y").where("x <> y")
    pairs_of = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return inner.unionByName(pairs_of).distinct().toDF("key_a", "key_b")


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each key: its class, how many records are in it, and to how many other classes it has links."""
    size = members.groupBy("class").agg(F.count("*").alias("copies"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(size, "class").join(links, "class", "left").select("key", "class", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
