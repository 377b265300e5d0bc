"""Tables that are replaced as a whole: readers see the old version or the new one, never a mix.

A version is a folder of its own; it is written in full and then published by a pointer, a small file whose number is one
above the last.  Only one writer can create a number: who finds it taken has lost and publishes nothing.  A
version carries the number of its rows and a digest of their content that any number of tasks can share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .records import canonical_json

LEAF = 1024


class Conflict(RuntimeError):
    """Another writer has published since the version that this one began from."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file with all of its text, or :class:`Conflict` if there is one of that name: written aside, then linked or renamed."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _files(spark, aside)
    stream = fs.create(p, False)
    stream.write(text.encode())
    stream.close()
    try:
        if urlparse(path).scheme in ("", "file"):
            local = lambda x: urlparse(x).path
            os.link(local(aside), local(path))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
            none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context.rename(p, spark._jvm.org.apache.hadoop.fs.Path(path), options)
    except FileExistsError as taken:
        raise Conflict(path) from taken
    except Exception as failed:
        if "FileAlreadyExists" in str(failed):
            raise Conflict(path) from failed
        raise
    finally:
        fs.delete(p, False)


def current(spark: SparkSession, root: str) -> dict | None:
    """What the newest pointer says: ``number, path, rows, digest``; None where nothing is published."""
    fs, folder = _files(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    found = [n for n in names if n.isdigit()]
    if not found:
        return None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{found[-1]}"))
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return json.loads(text) | {"number": int(found[-1])}


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or that of ``number`` (older ones stay as backups until :func:`prune`)."""
    if number is None:
        found = current(spark, root)
        if found is None:
            raise FileNotFoundError(root)
        return spark.read.parquet(found["path"])
    fs, p = _files(spark, f"{root}/pointers/{number:012d}")
    stream = fs.open(p)
    path = json.loads(bytes(stream.readAllBytes()).decode())["path"]
    stream.close()
    return spark.read.parquet(path)


def publish(df: DataFrame, root: str, after: int | None, levels: int | None = None) -> dict:
    """Write ``df`` as the version after number ``after`` (None: the first) and point to it; :class:`Conflict` if that number is taken.

    ``levels`` is that of :func:`tree_digest`.  Whatever fails before the pointer leaves readers with the old version.
    """
    spark, path = df.sparkSession, f"{root}/versions/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.parquet(path)
    facts = tree_digest(written, levels=levels).first()
    number = 0 if after is None else after + 1
    said = {"path": path, "rows": facts["rows"], "digest": facts["digest"]}
    try:
        _create(spark, f"{root}/pointers/{number:012d}", json.dumps(said))
    except Conflict:
        fs, p = _files(spark, path)
        fs.delete(p, True)
        raise
    return said | {"number": number}


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5, levels: int | None = None) -> dict:
    """Publish ``change`` of the newest version; begun anew from the newest one where another writer came first."""
    for _ in range(tries):
        now = current(spark, root)
        try:
            return publish(change(None if now is None else spark.read.parquet(now["path"])), root, None if now is None else now["number"], levels)
        except Conflict:
            continue
    raise Conflict(f"{root}: {tries} times")


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, and folders that no pointer names; returns how many folders went.

    A reader of an older version loses its files, so ``keep`` covers the longest read.
    """
    fs, folder = _files(spark, f"{root}/pointers")
    numbers = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
    kept = set()
    for n in numbers[-keep:]:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{n}"))
        kept.add(json.loads(bytes(stream.readAllBytes()).decode())["path"].rsplit("/", 1)[-1])
        stream.close()
    gone = [s.getPath() for s in fs.listStatus(_files(spark, f"{root}/versions")[1]) if s.getPath().getName() not in kept]
    for n in numbers[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{n}"), False)
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def ordered_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in one total order over all of them: ranges are sorted apart and their sizes added up.

    What meets in one task is a row for each range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(sorted_, "ordered").withColumns({"__part": F.shiftright("__at", 33), "__nth": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__nth")).drop("__part", "__nth", "__at", "__start")


def tree_digest(df: DataFrame, line: Column | None = None, levels: int | None = None) -> DataFrame:
    """One row ``rows, digest``: SHA-256 of the rows' canonical JSON in order, as a tree of ``LEAF`` at a time.

    Rows are ordered by their JSON, so the digest follows the content alone: not the number of files, nor their order.  Each
    level joins the hexadecimal digests of up to ``LEAF`` neighbours and digests them again, until one is left; a table
    without rows has the digest of an empty text.  With ``levels``, the last of so many joins all that is left: of two,
    64 bytes for each ``LEAF`` rows meet in one group.
    """
    lines = df.select((canonical_json(df) if line is None else line).alias("line"))
    level = ordered_numbers(lines, ["line"], "i").select("i", F.sha2(F.col("line").cast("binary"), 256).alias("h"))
    rows = n = level.count()
    if not rows:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows"), F.sha2(F.lit("").cast("binary"), 256).alias("digest"))
    depth = 0
    while True:
        depth += 1
        width = LEAF if levels is None or depth < levels else n
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(F.floor(F.col("i") / width).cast("long").alias("i")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))
        n = -(-n // width)
        if n <= 1:
            return level.select(F.lit(rows).cast("long").alias("rows"), F.col("h").alias("digest"))
