"""Session helpers: intermediate tables in the shared folder, results kept for an application, and the package on the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a folder of its own, once.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.shared.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("corpusloom.shared.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_KEPT: dict[tuple, Any] = {}
_CLEANED: set[str] = set()


def _delete(jvm, conf, path: str) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def own_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one; it is deleted when Python ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/corpusloom-{sc.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

        def clean() -> None:
            try:
                _delete(jvm, conf, path)
            except Exception:  # noqa: BLE001, S110 - the JVM may have ended before
                pass

        atexit.register(clean)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    return stored_with(df, name)[0]


def stored_with(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Row | dict]:
    """``stored``, and figures of the rows that the same pass gathers."""
    spark = df.sparkSession
    ship(spark)
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, *(c.alias(n) for n, c in figures.items())) if figures else df
    watched.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _PLACES[made] = path
    return made, seen.get if figures else {}


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind ``stored`` frames that no result needs any more."""
    for df in frames:
        path = _PLACES.pop(df, None)
        if path:
            sc = df.sparkSession.sparkContext
            _delete(sc._jvm, sc._jsc.hadoopConfiguration(), path)


def release(spark: SparkSession) -> None:
    """Delete all that this application has stored or kept. Frames made before can't be read any more."""
    sc = spark.sparkContext
    for key in [k for k in _KEPT if k[0] == sc.applicationId]:
        del _KEPT[key]
    _delete(sc._jvm, sc._jsc.hadoopConfiguration(), own_dir(spark))


def kept(spark: SparkSession, name: str, paths: list[str], make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in an application for the present files at ``paths``; a changed file makes it anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    state = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()  # lists the files, reads none
    key = (spark.sparkContext.applicationId, name, tuple(paths), *state)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python needn't find it by itself."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    made = Path(tempfile.mkdtemp(prefix="corpusloom-ship-")) / "corpusloom.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(made))
    _SHIPPED.add(app)


def ranked(df: DataFrame, name: str, *order: str, rows: int = 200_000) -> DataFrame:
    """``df`` with ``rank``, its place from 0 in the given order, without a single task: range-sorted, then counted by partition.

    Each task sorts about ``rows`` rows; the starts of the partitions, one row each, are joined by broadcast.
    """
    count = df.count()
    sorted_ = df.repartitionByRange(max(1, -(-count // rows)), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    held = stored(sorted_.withColumn("__part", F.shiftright(at, 33)).withColumn("__local", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    starts, before = [], 0
    for part, n in sorted((r[0], r[1]) for r in held.groupBy("__part").count().collect()):  # one row for each partition
        starts.append((part, before))
        before += n
    first = df.sparkSession.createDataFrame(starts, "__part bigint, __first bigint")
    return held.join(F.broadcast(first), "__part").withColumn("rank", F.col("__local") + F.col("__first")).drop("__part", "__local", "__first")


def running(df: DataFrame, name: str, value: str, *order: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over the rows that come earlier in the given order, without a single task."""
    held = ranked(df, name, *order)
    part = F.floor(F.col("rank") / 200_000)
    placed = held.withColumn("__part", part)
    sums, total = [], 0
    for p, s in sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(F.sum(value)).collect()):  # one row for each 200,000
        sums.append((p, total))
        total += s or 0
    first = df.sparkSession.createDataFrame(sums, "__part bigint, __first bigint")
    within = F.sum(value).over(Window.partitionBy("__part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("__in", F.coalesce(within, F.lit(0))).join(F.broadcast(first), "__part").withColumn("before", F.col("__in") + F.col("__first")).drop("__part", "__in", "__first", "rank")
