"""Tables of immutable Parquet files with versions: a reader pins one, a merge makes the next in one atomic step.

    <root>/data/<run>/part=<part>/...   files of one merge, never changed
    <root>/versions/<number>            which run has each part, one line per part

A part is a month of prices or a disclosure date of holdings, so a version's list is bounded by the calendar. A merge
writes the parts that it touches as a new run and then puts the list of the next number in place by a rename that fails
if the number is taken; until then nobody sees its files. A merge that died leaves a run that no list names. ``expire``
removes those and old versions. The rename is atomic on local and HDFS folders; an object store needs a connector with
conditional writes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.session import file_system, settle

_PART = "_part"
ATTEMPTS = 5  # of a merge whose version number was taken by another
GRACE_S = 24 * 3600  # a run younger than this may belong to a merge that has not published yet


class Taken(RuntimeError):
    """Another merge has published the next version first."""


@dataclass(frozen=True)
class Version:
    """What a reader pins: the number, and the run that has each part."""
    number: int
    runs: dict[str, str]


def _list(spark: SparkSession, folder: str) -> list:
    system, path = file_system(spark, folder)
    return list(system.listStatus(path)) if system.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that can be read, ascending."""
    names = [status.getPath().getName() for status in _list(spark, f"{root}/versions")]
    return sorted(int(name) for name in names if name.isdigit())


def pin(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version, or a given one; version 0 of a table without any has no parts."""
    numbers = versions(spark, root)
    if number is None:
        number = numbers[-1] if numbers else 0
    if number == 0:
        return Version(0, {})
    if number not in numbers:
        raise ValueError(f"version {number} of {root} is not there; there are {numbers}")
    rows = spark.read.text(f"{root}/versions/{number:010d}").collect()  # one line per part
    return Version(number, dict(r.value.split("\t") for r in rows if r.value))


def read(spark: SparkSession, root: str, schema: str, version: Version | None = None, parts: Iterable[str] | None = None) -> DataFrame:
    """The rows of a version, of the given parts only if some are named. Its files never change, so a result built on it
    stays as it is whatever is merged meanwhile."""
    runs = (version or pin(spark, root)).runs
    wanted = runs if parts is None else [p for p in parts if p in runs]
    paths = [f"{root}/data/{runs[p]}/{_PART}={p}" for p in sorted(wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    system, folder = file_system(spark, f"{root}/versions")
    system.mkdirs(folder)
    jvm = spark.sparkContext._jvm
    made = f"{root}/versions/.{uuid.uuid4().hex}"
    out = system.create(file_system(spark, made)[1], False)
    try:
        out.write("".join(f"{part}\t{run}\n" for part, run in sorted(version.runs.items())).encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri(),
                                                                   spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(file_system(spark, made)[1], file_system(spark, f"{root}/versions/{version.number:010d}")[1], never_over)
    except Exception as failed:
        system.delete(file_system(spark, made)[1], False)
        if version.number in versions(spark, root):
            raise Taken(f"version {version.number} of {root} is taken") from failed
        raise


def _write_run(rows: DataFrame, root: str, part: str, order: list[str]) -> dict[str, str]:
    """Writes a run, a part a folder, and returns the parts that have rows."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    # rebalance splits a large part over several files and merges small ones
    (rows.withColumn(_PART, F.expr(part)).hint("rebalance", _PART).sortWithinPartitions(_PART, *order)
         .write.partitionBy(_PART).parquet(f"{root}/data/{run}"))
    names = [status.getPath().getName() for status in _list(spark, f"{root}/data/{run}")]
    return {name.removeprefix(f"{_PART}="): run for name in names if name.startswith(f"{_PART}=")}


def replace(rows: DataFrame, root: str, part: str, order: list[str]) -> Version:
    """Makes the rows the table's next version, whatever it held before; ``part`` is the SQL of a row's part."""
    spark = rows.sparkSession
    version = Version(pin(spark, root).number + 1, _write_run(rows, root, part, order))
    _publish(spark, root, version)
    return version


def merge(incoming: DataFrame, root: str, schema: str, part: str, order: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame],
          settled: bool = False) -> Version:
    """The next version: the parts that ``incoming`` touches become ``combine(stored, incoming)`` of their rows, all others are
    taken over as they are. If another merge publishes first, this one starts again from its version. Rows without a
    part are left out; merging nothing makes no version. ``settled`` says that ``incoming`` is read from files already."""
    spark = incoming.sparkSession
    incoming = incoming.filter(F.expr(part).isNotNull())
    incoming = incoming if settled else settle(incoming, "incoming")
    touched = [r[0] for r in incoming.select(F.expr(part)).distinct().collect()]  # bounded by the calendar
    if not touched:
        return pin(spark, root)
    for attempt in range(ATTEMPTS):
        base = pin(spark, root)
        written = _write_run(combine(read(spark, root, schema, base, touched), incoming), root, part, order)
        runs = {p: run for p, run in base.runs.items() if p not in touched} | written
        try:
            _publish(spark, root, Version(base.number + 1, runs))
        except Taken:
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        return Version(base.number + 1, runs)
    raise AssertionError


def expire(spark: SparkSession, root: str, keep: int = 2, grace_s: float = GRACE_S) -> None:
    """Takes away all but the newest ``keep`` versions, and runs older than ``grace_s`` that none of those names. A reader
    that pinned a version taken away can no longer read it."""
    numbers = versions(spark, root)
    kept = numbers[-keep:]
    for number in numbers[:-keep]:
        system, path = file_system(spark, f"{root}/versions/{number:010d}")
        system.delete(path, False)
    named = {run for number in kept for run in pin(spark, root, number).runs.values()}
    for status in _list(spark, f"{root}/data"):
        if status.getPath().getName() not in named and status.getModificationTime() <= (time.time() - grace_s) * 1000:
            file_system(spark, f"{root}/data")[0].delete(status.getPath(), True)
