"""The k most similar vectors of every vector, by learned partitions of the space.

A bounded sample is linked to its nearest neighbours, the graph of these links is cut into balanced parts (recursive
spectral bisection at the median), and a softmax classifier learns to which parts a vector and its neighbours belong.
Every vector of the collection is put into its few most probable cells; within a cell all vectors are compared with
one another, in float32, and the best of its cells make a vector's result. Cells grow in number with the collection; beyond
what one sample can teach, each cell is partitioned again by a sample of its own, on the executors, so that the cost of a
vector stays level up to some 16 million vectors. A crowded cell is compared block by block in several tasks.

Similarity is the cosine; equal similarities rank by smaller id; a vector is no neighbour of itself. Null vectors, all
zeros, other lengths and values that aren't finite count nowhere. Equal vectors are searched once and share their
result, which lists the class's own smallest ids first. A repeated row counts once; of an id with different vectors
the one with the smallest hash counts. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from corpusloom.llm.arrowtext import int_lists
from corpusloom.session import ship, stored

#: Vectors of the training sample; links of each; vectors that a cell should get from its first choices; cells of each vector.
SAMPLE, LINKS, CELL, CHOICES = 8192, 10, 512, 4
#: Probability from which a cell that isn't the first choice gets the vector too.
WORTH = 0.06
#: Principal directions that a classifier sees at most, sample vectors for each of them, and the fewest that may teach a cell.
DIRECTIONS, SEEN, TEACHERS = 192, 24, 32
#: With two levels a cell of the first is cut into one in ``FINE`` of the cells that one sample can teach: the first level, whose
#: sample sees few members of each dense region, stays coarse, so that its cells keep neighbours together.
FINE = 3
#: Vectors of a crowded cell that one task compares at once, and classes that are broadcast at most.
BLOCK, BROADCAST_ROWS = 8192, 500_000


@dataclass
class Router:
    mean: np.ndarray
    directions: np.ndarray
    weights: np.ndarray | None  # None: the directions are those of the cells
    bias: np.ndarray
    shut: tuple[int, ...] = ()  # cells that get no vector, since they would hold too few

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The probability of each cell for each row of ``x``."""
        z = (x - self.mean) @ self.directions.astype(np.float32, copy=False)
        z = (z if self.weights is None else z @ self.weights) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def choose(self, x: np.ndarray, choices: int, worth: float = WORTH) -> tuple[np.ndarray, np.ndarray]:
        """The most probable cells of the rows of ``x`` (flat), and how many each row has: the first, and others worth it."""
        z = self.odds(x)
        z[:, list(self.shut)] = -1
        top = np.argsort(-z, axis=1, kind="stable")[:, :choices]
        good = np.take_along_axis(z, top, 1) >= worth
        good[:, 0] = True
        return top[good].astype(np.int32), good.sum(1)


@dataclass
class Levels:
    """A router whose cells are partitioned again, each by a router of its own; cells are numbered through from ``first`` on."""

    top: Router
    below: dict[int, Router]
    first: np.ndarray
    shut: tuple[int, ...] = ()
    spare: int = 0  # the cell of a vector whose likely cells are all shut

    def choose(self, x: np.ndarray, choices: int, worth: float = WORTH) -> tuple[np.ndarray, np.ndarray]:
        cells, count = self.top.choose(x, choices, worth)
        row = np.repeat(np.arange(len(x)), count)
        upper = self.top.odds(x)[row, cells]
        parts = []
        for c in np.unique(cells):
            at = np.flatnonzero(cells == c)
            if c in self.below:
                z = self.below[c].odds(x[row[at]]) * upper[at, None]
                take = min(choices, z.shape[1])
                best = np.argpartition(-z, take - 1, axis=1)[:, :take]
                parts.append((np.repeat(row[at], take), (self.first[c] + best).ravel(), np.take_along_axis(z, best, 1).ravel()))
            else:
                parts.append((row[at], np.full(len(at), self.first[c]), upper[at]))
        row, cell, odds = (np.concatenate([p[i] for p in parts]) for i in range(3))
        open_ = ~np.isin(cell, self.shut)
        row, cell, odds = row[open_], cell[open_], odds[open_]
        lost = np.setdiff1d(np.arange(len(x)), row)
        row, cell, odds = np.append(row, lost), np.append(cell, np.full(len(lost), self.spare)), np.append(odds, np.ones(len(lost)))
        order = np.lexsort((cell, -odds, row))
        row, cell, odds = row[order], cell[order], odds[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        good = (rank == 0) | ((rank < choices) & (odds >= worth))
        return cell[good].astype(np.int32), np.bincount(row[good], minlength=len(x))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row (exact; for the sample only)."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(links: np.ndarray, depth: int, turns: int = 60) -> np.ndarray:
    """Cut a graph into 2**depth parts of equal size: each part is halved at the median of its second eigenvector."""
    n, k = links.shape
    rng, part = np.random.default_rng(7), np.zeros(n, np.int64)
    for level in range(depth):
        groups = 1 << level
        inside = (part[links] == part[:, None]).ravel()
        a, b = np.repeat(np.arange(n), k)[inside], links.ravel()[inside]
        degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
        size, mass = np.bincount(part, minlength=groups), np.bincount(part, degree, groups)
        v = rng.standard_normal(n)
        for _ in range(turns):
            v = v - (np.bincount(part, v * degree, groups) / mass)[part]
            v = 0.5 * v + 0.5 * (np.bincount(a, v[b], n) + np.bincount(b, v[a], n)) / degree
            v /= np.sqrt(np.bincount(part, v * v, groups) / size)[part] + 1e-12
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - (np.cumsum(size) - size)[part[order]]
        part = part * 2 + (rank >= size[part] // 2)
    return part


def learn(x: np.ndarray, cells: int, turns: int = 120, most: int = DIRECTIONS) -> Router:
    """A router to ``cells`` (a power of two) learnt from the rows of ``x``, seen in at most ``most`` directions."""
    n, width = x.shape
    mean = x.mean(0) if n else np.zeros(width, np.float32)
    if cells < 2:
        return Router(mean, np.zeros((width, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    links = graph(x, min(LINKS, n - 1))
    part = balanced_parts(links, cells.bit_length() - 1)
    centred = x - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    directions = vectors[:, ::-1][:, : max(1, min(most, width, n // SEEN))].astype(np.float32)
    f = centred @ directions
    scale = f.std() + 1e-9
    f /= scale
    target = np.zeros((n, cells), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), links.shape[1]), part[links].ravel()), 0.5 / links.shape[1])
    target[np.arange(n), part] += 0.5
    w, b = np.zeros((f.shape[1], cells), np.float32), np.zeros(cells, np.float32)
    moments = [np.zeros_like(y) for y in (w, w, b, b)]
    for step in range(1, turns + 1):
        z = f @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - target) / n
        for y, grad, m, v in ((w, f.T @ g + 1e-5 * w, *moments[:2]), (b, g.sum(0), *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            y -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    directions /= np.float32(scale)
    if cells < directions.shape[1]:  # one product is smaller than two
        return Router(mean.astype(np.float32), directions @ w, None, b)
    return Router(mean.astype(np.float32), directions, w, b)


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _units(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' places, and their vectors with length 1."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        norm = np.sqrt((flat.astype(np.float64) ** 2).sum(1))
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return good, (flat[good] / norm[good, None]).astype(np.float32)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of float32 without loss, byte by byte of the numbers, compressed; as half floats where these hold the same numbers."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    with np.errstate(over="ignore"):
        halves = x.astype(np.float16)
    short = (halves.astype(np.float32) == x).all(1)
    planes = lambda y: y.view(np.uint8).reshape(len(y), -1, y.itemsize).transpose(0, 2, 1)
    return [squeeze.compress((h if c else w).tobytes()) for h, w, c in zip(planes(halves), planes(x), short.tolist(), strict=True)]


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    import zstandard

    loose = zstandard.ZstdDecompressor()
    raw = [loose.decompress(r) for r in rows]
    size, out = np.fromiter(map(len, raw), np.int64, len(raw)), np.empty((len(rows), width), np.float32)
    for kind in (np.float16, np.float32):
        at = np.flatnonzero(size == width * np.dtype(kind).itemsize)
        if len(at):
            planes = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), -1, width)
            out[at] = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind).reshape(len(at), width)
    return out


def best_within(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the ids and similarities (in millionths) of its k best in ``other``; -1 where there are fewer.

    All rows that are equal in millionths to the last one taken are candidates, so that the smaller ids are found.
    """
    found, value = np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int32)
    take = min(k + 1, len(other_ids))

    def best(near: np.ndarray, score: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.rint(score * 1e6).astype(np.int32)
        score[near == own] = -2_000_000
        order = np.lexsort((near, -score), axis=1)[:, :k]
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        near[score == -2_000_000] = -1
        return near, score

    for i in range(0, len(ids), 256):
        s, own = x[i : i + 256] @ other.T, ids[i : i + 256, None]
        top = np.argpartition(-s, take - 1, axis=1)[:, :take]
        score = np.take_along_axis(s, top, 1)
        near, millionths = best(other_ids[top], score, own)
        found[i : i + 256, : near.shape[1]], value[i : i + 256, : near.shape[1]] = near, millionths
        least = (np.rint(score.min(1) * 1e6) - 0.6) / 1e6  # a little below what rounds to the last one's millionths
        for r in np.flatnonzero((s >= least[:, None].astype(np.float32)).sum(1) > take):
            more = np.flatnonzero(s[r] >= np.float32(least[r]))
            near, millionths = best(other_ids[more][None], s[r, more][None], own[r : r + 1])
            found[i + r, : near.shape[1]], value[i + r, : near.shape[1]] = near[0], millionths[0]
    return found, value


def first_level(wanted: int, teachable: int) -> tuple[int, bool]:
    """The cells of the first level (a power of two), and whether there is a second, where one sample can teach ``teachable`` cells."""
    cells = 1 << (max(1, min(wanted, teachable)).bit_length() - 1)
    if cells == 1 or wanted < 2 * cells:
        return cells, False
    return min(cells, 1 << (max(2, -(-wanted * FINE // cells)) - 1).bit_length()), True


def _second_level(rows: DataFrame, top: Router, count: int, cell: int, sample: int, width: int) -> Levels:
    """Partition each cell of ``top`` again, by a sample of its own (half of ``sample`` vectors or more, at most twice as many), cell by cell on the executors."""
    spark, cells = rows.sparkSession, len(top.bias)
    taken = min(2 * sample, max(sample // 2, 2 * TEACHERS * (count // cell) // cells))
    held = spark.sparkContext.broadcast(top)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = _units(_flat(batch.column(1), width))
            of = held.value.odds(unit).argmax(1) if len(good) else good
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good))], ["cell", "id", "v"])

    order = F.xxhash64("id", F.lit("below"))
    share = min(1.0, 5 * taken * cells / max(4 * count, 1))  # cells differ in size
    few = rows.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * share))
    placed = few.select("id", "v").mapInArrow(first, "cell int, id bigint, v array<float>")
    placed = placed.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(order, "id"))).withColumn("held", F.count("*").over(Window.partitionBy("cell"))).where(F.col("r") <= taken)

    def teach(table: pa.Table) -> pa.Table:
        x = np.unique(_units(_flat(table.column("v").combine_chunks(), width))[1], axis=0)
        wanted = max(1, min(int(table.column("held")[0].as_py() / share) // cell, len(x) // TEACHERS))
        made = learn(x, 1 << (wanted.bit_length() - 1)) if wanted > 1 else None
        if made:
            made.directions = made.directions.astype(np.float16)  # the driver gets and sends all of them
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "router": pa.array([pickle.dumps(made) if made else None], pa.binary())})

    taught = placed.groupBy("cell").applyInArrow(teach, "cell int, router binary").where("router IS NOT NULL")
    below = {r["cell"]: pickle.loads(r["router"]) for r in taught.collect()}  # at most a row of bounded size for each cell of the first level
    sizes = np.array([len(below[c].bias) if c in below else 1 for c in range(cells)])
    return Levels(top, below, np.cumsum(sizes) - sizes)


def _compare(width: int, k: int):
    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _units(unpacked(table.column("payload").to_pylist(), width))[1]
        own, p, q = (table.column(c).to_numpy() for c in ("own", "p", "q"))
        if p[0] == q[0]:
            sides = [(slice(None), slice(None))]
        else:
            sides = [(np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0]))]
            sides.append(sides[0][::-1])
        made = [(ids[a], *best_within(ids[a], x[a], ids[b], x[b], k)) for a, b in sides if len(ids[a]) and len(ids[b])]
        if not made:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.list_(pa.int32()))})
        who, near, score = (np.concatenate([m[i] for m in made]) for i in range(3))
        offsets = pa.array(np.arange(len(who) + 1, dtype=np.int32) * k)
        return pa.table({"id": pa.array(who), "near": pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), "score": pa.ListArray.from_arrays(offsets, pa.array(score.ravel()))})

    return compare


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def nearest(df: DataFrame, key: str, vector: str, *, width: int = 768, k: int = 10, choices: int = CHOICES, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(id, near): the ids of the k most similar vectors of every usable vector, best first."""
    spark = df.sparkSession
    ship(spark)
    most, least = F.array_max("v"), F.array_min("v")
    usable = (F.size(F.array_compact("v")) == width) & (F.size("v") == width) & ~F.isnan(most) & (most < float("inf")) & (least > float("-inf")) & ((most > 0) | (least < 0))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable)
    count = rows.count()
    taught = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(count, 1)))).limit(sample * 5 // 4)
    got = taught.select("v").toArrow().column(0).combine_chunks()
    x = np.unique(_units(_flat(got, width))[1], axis=0) if len(got) else np.zeros((0, width), np.float32)
    cells, deep = first_level(count // cell, len(x) // TEACHERS)
    taught_router: Router | Levels = learn(x, cells)
    total = len(taught_router.bias)
    if deep:
        taught_router = _second_level(rows, taught_router, count, cell, sample, width)
        total = int(taught_router.first[-1] + (len(taught_router.below[len(taught_router.first) - 1].bias) if len(taught_router.first) - 1 in taught_router.below else 1))
    router = spark.sparkContext.broadcast(taught_router)  # some megabytes, bounded by the sample

    def route(batches, router=router, whole=True):
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                flat = _flat(part.column(1), width)
                good, unit = _units(flat)
                own, count = router.value.choose(unit, choices) if len(good) else (np.zeros(0, np.int32), good)
                payload = pa.array(packed(flat[good]), pa.binary()) if whole else pa.nulls(len(good), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good)), payload, int_lists(own, count)], ["id", "payload", "cells"])

    # equal vectors become one class, named by its smallest id; the ids that can be anyone's neighbours are its first k + 1
    rows = rows.withColumn("same", F.xxhash64("v"))
    ids = stored(rows.groupBy("id").agg(F.min("same").alias("same"), F.count("*").alias("rows")), "vector-ids")
    classes = ids.groupBy("same").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    copied = classes.where("n > 1").select("same", "class")
    rank = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    members = stored(ids.join(_few(copied), "same"), "members")
    first = members.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("first"))
    shut = members.where("id <> class").select("id")
    repeated = ids.where("rows > 1").select("id", "same")
    again = rows.join(_few(repeated), ["id", "same"], "left_semi").dropDuplicates(["id"])
    standing_rows = rows.join(_few(repeated.select("id")), "id", "left_anti").unionByName(again).join(_few(shut), "id", "left_anti").select("id", "v")
    # how many vectors each cell would get: one with too few to make k neighbours is shut, so that its vectors go to their next
    # cells; a crowded one is compared block by block
    cells_only = standing_rows.mapInArrow(lambda it: route(it, whole=False), "id bigint, payload binary, cells array<int>").select(F.explode("cells").alias("cell"))
    held = {r["cell"]: r["rows"] for r in cells_only.groupBy("cell").agg(F.count("*").alias("rows")).collect()}  # a row for each cell
    scant = sorted(held, key=lambda c: (held[c], c))[:-1]
    shut_cells = tuple(c for c in range(total) if held and (c not in held or c in scant and held[c] <= k))
    last = spark.sparkContext.broadcast(replace(taught_router, shut=shut_cells, **({"spare": max(held, key=lambda c: (held[c], -c))} if isinstance(taught_router, Levels) else {}))) if shut_cells else router
    routed = standing_rows.select("id", "v").mapInArrow(lambda it: route(it, last), "id bigint, payload binary, cells array<int>")
    standing = routed.select("id", "payload", F.explode("cells").alias("cell"))
    crowd = spark.createDataFrame([(c, n) for c, n in held.items() if n > BLOCK], "cell int, rows bigint")
    blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK).cast("int"), F.lit(1))
    placed = standing.join(F.broadcast(crowd), "cell", "left").withColumn("blocks", blocks)  # at most one row for each cell
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "payload")
    near = placed.groupBy("cell", "p", "q").applyInArrow(_compare(width, k), "id bigint, near array<bigint>, score array<int>")
    ordered = F.array_sort(F.flatten(F.collect_list(F.transform(F.arrays_zip("score", "near"), lambda s: F.struct((-s["score"]).alias("s"), s["near"].alias("near"))))))
    merged = near.groupBy("id").agg(ordered.alias("all"))
    merged = merged.select("id", F.slice(F.array_distinct(F.filter(F.transform("all", lambda s: s["near"]), lambda n: n >= 0)), 1, k).alias("near"))
    # neighbours stand for their classes; a class's own ids come first
    seen = merged.select("id", F.posexplode("near").alias("at", "class")).join(_few(first), "class", "left")
    listed = seen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("first", F.array("class")).alias("ids")))).alias("x"))
    listed = listed.select("id", F.flatten(F.transform("x", lambda s: s["ids"])).alias("near"))
    listed = stored(listed, "listed")
    single = listed.join(_few(first.select(F.col("class").alias("id"))), "id", "left_anti").select("id", F.slice("near", 1, k).alias("near"))
    several = members.join(first, "class").join(listed.withColumnRenamed("id", "class"), "class", "left")
    several = several.select("id", F.slice(F.filter(F.concat("first", F.coalesce("near", F.array().cast("array<bigint>"))), lambda n: n != F.col("id")), 1, k).alias("near"))
    return single.unionByName(several)


def pairs(found: DataFrame) -> DataFrame:
    """Distinct (chunk_a, chunk_b), a < b, where either is among the other's neighbours."""
    each = found.select("id", F.explode("near").alias("near"))
    return each.select(F.least("id", "near").alias("chunk_a"), F.greatest("id", "near").alias("chunk_b")).distinct()
