"""Fill containers of fixed capacity with whole items, by bulk-synchronous best fit.

An item larger than the capacity is divided into full containers and a remainder; all else stays whole. Items smaller
than a sixteenth of the capacity are first bundled, neighbours in size order, into units of up to an eighth, so that a
round places many of them at once. Units over half the capacity open a container each. Then rounds follow:

* units and the gaps of the open containers are range-sorted by size over all tasks;
* every task sweeps its range from the largest size down, giving each unit the smallest gap seen so far that is still
  free (its successor), as best fit would;
* what a range leaves over is matched across ranges by rank: the counts of each range, which are few, say which ranks
  of unmatched units meet which ranks of free gaps;
* gaps shrink by what they took; what the gaps can't hold opens containers, for the largest units that are left.

A gap takes one unit in a round, so conflicts can't arise; the rounds end when every unit has its container. Null and
empty items take no part; items of equal size are placed by key, so that a run can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import discard, ranked, stored, stored_with

CAPACITY = 2048
#: Rows that one task sweeps.
SWEEP = 200_000


def bundled(sizes: np.ndarray, most: int) -> np.ndarray:
    """Where bundles start: neighbours are taken while they hold at most ``most`` together; one search for each bundle."""
    ends = np.cumsum(sizes)
    starts, at = [], 0
    while at < len(sizes):
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
    return np.array(starts, np.int64)


def _bundles(small: DataFrame, most: int) -> DataFrame:
    """Units (unit, size, items) of neighbouring small items with at most ``most`` in each."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            starts = bundled(sizes, most)
            items = pa.ListArray.from_arrays(pa.array(np.append(starts, len(sizes)), pa.int32()), batch.column(0))
            total = np.add.reduceat(sizes, starts) if len(starts) else sizes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(total, pa.int64()), items], schema=_UNIT)

    return small.select("item", "size").mapInArrow(bundle, "unit string, size bigint, items array<string>")


_UNIT = pa.schema([("unit", pa.string()), ("size", pa.int64()), ("items", pa.list_(pa.string()))])
_SWEPT = "part int, id string, size bigint, gap boolean, box bigint, room bigint, turn bigint"


def matched(gap: np.ndarray) -> np.ndarray:
    """For each unit of a sweep the place of the gap it takes, -1 for none: of the free gaps before it the last, as brackets match.

    Gaps open and units close. At any height openings and closings take turns, so that a sort by height puts each pair together.
    """
    steps = np.where(gap, 1, -1)
    total = np.cumsum(steps)
    height = total - np.minimum(np.minimum.accumulate(total), 0)  # a unit that finds nothing leaves the height at 0
    before = np.concatenate([[0], height[:-1]]) if len(gap) else height
    level = np.where(gap, height, before)
    found = np.full(len(gap), -1, np.int64)
    rows = np.flatnonzero(level > 0)
    rows = rows[np.lexsort((rows, level[rows]))]
    pair = np.flatnonzero(gap[rows[:-1]] & ~gap[rows[1:]] & (level[rows[:-1]] == level[rows[1:]]))
    found[rows[pair + 1]] = rows[pair]
    return found


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep one range from the largest size down. A row for each unit and each free gap: ``box`` where matched, else its ``turn``.

    ``turn`` counts unmatched units in sweep order, and free gaps from the smallest up: the order in which they meet.
    """
    from pyspark import TaskContext

    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, size, gap, box = (rows.column(i) for i in range(4))
    opens, sizes = gap.to_numpy(zero_copy_only=False).astype(bool), size.to_numpy()
    boxes = box.fill_null(-1).to_numpy()
    took = matched(opens)
    units = np.flatnonzero(~opens)
    free = np.setdiff1d(np.flatnonzero(opens), took[took >= 0], assume_unique=False)[::-1]  # the smallest first
    of, alone = took[units], took[units] < 0
    turn = np.concatenate([np.cumsum(alone) - 1, np.arange(len(free))])
    place = np.concatenate([units, free])
    room, where_ = np.concatenate([sizes[of], sizes[free]]), np.concatenate([boxes[of], boxes[free]])
    single, given = np.concatenate([alone, np.ones(len(free), bool)]), np.concatenate([~alone, np.ones(len(free), bool)])
    made = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(place), TaskContext.get().partitionId(), np.int32)), ids.combine_chunks().take(pa.array(place)) if len(place) else pa.array([], pa.string()), pa.array(sizes[place], pa.int64()),
            pa.array(opens[place]), pa.array(where_, pa.int64(), mask=~given), pa.array(room, pa.int64(), mask=~given), pa.array(turn, pa.int64(), mask=~single),
        ],
        ["part", "id", "size", "gap", "box", "room", "turn"],
    )
    yield from (made.slice(i, 20_000) for i in range(0, made.num_rows, 20_000))


def _meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (range, unmatched units, free gaps), largest sizes first: (unit range, first turn, gap range, first turn, how many)."""
    stack: list[list[int]] = []
    out = []
    for part, units, gaps in counts:
        done = 0
        while done < units and stack:
            other, first, n = stack[-1]
            take = min(n, units - done)
            out.append((part, done, other, first, take))
            done += take
            stack[-1] = [other, first + take, n - take]
            if n == take:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps])
    return out


def match(units: DataFrame, gaps: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (id, size, box, room) of matched units, (id, size) of the others, and the stored sweep that both read."""
    both = units.select(F.col("unit").alias("id"), "size", F.lit(False).alias("gap"), F.lit(None).cast("bigint").alias("box")).unionByName(
        gaps.select(F.lit(None).cast("string").alias("id"), F.col("room").alias("size"), F.lit(True).alias("gap"), "box")
    )
    order = (F.desc("size"), F.desc("gap"), F.asc("box"), F.asc("id"))
    swept = stored(both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "swept")
    left = swept.where("turn IS NOT NULL").groupBy("part").agg(F.count_if(~F.col("gap")).alias("units"), F.count_if("gap").alias("gaps"))
    met = _meetings(sorted((r["part"], r["units"], r["gaps"]) for r in left.collect()))  # one row for each range
    inside = swept.where("NOT gap AND turn IS NULL").select("id", "size", "box", "room")
    alone = swept.where("NOT gap AND turn IS NOT NULL").select("part", "id", "size", "turn")
    if not met:
        return inside, alone.select("id", "size"), swept
    spark = units.sparkSession
    plan = F.broadcast(spark.createDataFrame(met, "part int, u bigint, gap_part int, g bigint, n bigint"))  # at most two for each range
    called = alone.join(plan, (alone["part"] == plan["part"]) & (alone["turn"] >= plan["u"]) & (alone["turn"] < plan["u"] + plan["n"]), "left")
    called = called.select(alone["id"], alone["size"], "gap_part", (plan["g"] + alone["turn"] - plan["u"]).alias("gap_turn"))
    free = swept.where("gap").select(F.col("part").alias("gap_part"), F.col("turn").alias("gap_turn"), "box", "room")
    across = called.join(free, ["gap_part", "gap_turn"], "left")
    return inside.unionByName(across.where("box IS NOT NULL").select("id", "size", "box", "room")), across.where("box IS NULL").select("id", "size"), swept


def pack(df: DataFrame, key: str, size: str, *, capacity: int = CAPACITY) -> DataFrame:
    """(key, start, size, box): every part of every item with its container; ``start`` is 0 unless the item was divided.

    Sizes that are null or not positive take no part. A repeated row counts once; of a key with several sizes the largest counts.
    """
    spark = df.sparkSession
    items = df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("whole")).where(F.col("whole") > 0)
    items = items.groupBy("key").agg(F.max("whole").alias("whole"))
    # full containers of divided items; their numbers come after those of the others
    items = stored(items, "items")
    full = items.where(F.col("whole") >= capacity).select("key", F.explode(F.sequence(F.lit(0), F.floor(F.col("whole") / capacity) - 1)).alias("i"))
    full = full.select("key", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"))
    rest = items.where(F.col("whole") % capacity > 0).select(
        F.col("key").cast("string").alias("item"), (F.col("whole") % capacity).alias("size")
    )
    small = rest.where(F.col("size") < capacity // 16)
    parts = max(1, math.ceil(small.count() / SWEEP))
    made = _bundles(small.repartitionByRange(parts, "size", "item").sortWithinPartitions("size", "item"), capacity // 8)
    units = stored(rest.where(F.col("size") >= capacity // 16).select(F.col("item").alias("unit"), "size", F.array("item").alias("items")).unionByName(made), "units")
    wide = ranked(units.where(F.col("size") > capacity // 2).select("unit", "size"), "wide", "size", "unit")
    boxes = wide.count()
    placed = [wide.select("unit", F.col("rank").alias("box"))]
    gaps = wide.select(F.col("rank").alias("box"), (capacity - F.col("size")).alias("room")).where("room > 0")
    left = units.where(F.col("size") <= capacity // 2).select("unit", "size")
    waiting, open_ = left.count(), boxes
    while waiting:
        found, others, swept = match(left, gaps, max(1, math.ceil((waiting + open_) / SWEEP)))
        found = stored(found, "found")
        before = (left, gaps)
        others, of = stored_with(others.toDF("unit", "size"), "others", n=F.count(F.lit(1)), need=F.sum("size"), least=F.min("size"))
        placed.append(found.select(F.col("id").alias("unit"), "box"))
        n, need, least = of["n"], of["need"], of["least"]
        gaps = gaps.join(found.groupBy("box").agg(F.sum("size").alias("took")), "box", "left").select("box", (F.col("room") - F.coalesce("took", F.lit(0))).alias("room")).where("room > 0")
        usable = F.when(F.col("room") >= (least or 0), F.col("room"))
        gaps, of = stored_with(gaps, "gaps", n=F.count(F.lit(1)), room=F.sum(usable))
        discard(swept, *before)
        open_ = of["n"]
        left = others
        if n:
            # what the gaps that take any unit at all can't hold opens containers, for the largest units;
            # if few found a place the gaps are too scattered, and half of the volume gets new ones
            fresh = max(0, math.ceil((need - (of["room"] or 0)) / capacity))
            if n > 0.8 * waiting:
                fresh = max(fresh, math.ceil(need / capacity / 2))
            if fresh:
                order = ranked(others.withColumn("down", -F.col("size")), "order", "down", "unit")
                opened = order.where(F.col("rank") < fresh)
                placed.append(opened.select("unit", (F.col("rank") + boxes).alias("box")))
                gaps = gaps.unionByName(opened.select((F.col("rank") + boxes).alias("box"), (capacity - F.col("size")).alias("room")))
                boxes, open_ = boxes + min(fresh, n), open_ + min(fresh, n)
                left = order.where(F.col("rank") >= fresh).select("unit", "size")
        waiting = max(0, n - fresh) if n and fresh else n
    in_box = placed[0]
    for more in placed[1:]:
        in_box = in_box.unionByName(more)
    of_items = units.join(in_box, "unit").select(F.explode("items").alias("item"), "box")
    ends = items.where(F.col("whole") % capacity > 0).withColumn("item", F.col("key").cast("string"))
    ends = ends.join(of_items, "item").select("key", (F.col("whole") - F.col("whole") % capacity).alias("start"), (F.col("whole") % capacity).alias("size"), "box")
    full = ranked(full, "full", "key", "start").select("key", "start", "size", (F.col("rank") + boxes).alias("box"))
    return ends.unionByName(full).withColumnRenamed("key", key)
