"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine (tests).

    A cluster without the setting is an error: executors would write to their own disks and rows would be lost.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs in here go when it ends (not before: a lost executor's are made again).

    For queries whose result nobody computes again from these files. The session's setting comes back afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut, and no lost executor takes rows along."""
    path = fresh_path(df.sparkSession, name)
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal_array(values, kind: str) -> Column:
    """A constant array from one literal, instead of one expression for each value. Values hold no comma."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_in(value: Column, bounds: list, kind: str) -> Column:
    """How many of the ascending bounds are at most value, by binary search (null: 0)."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    array = literal_array(bounds, kind)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    reached = lambda v, at: (at <= n) & (F.element_at(array, F.least(at, F.lit(n))) <= v)
    return let(value, lambda v: F.aggregate(steps, F.lit(0), lambda low, step: F.when(reached(v, low + step), low + step).otherwise(low)))


def unit_interval(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the given columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hex16(value: Column) -> Column:
    """A long as 16 hexadecimal digits, upper case, as if unsigned."""
    return F.lpad(F.hex(value), 16, "0")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch of long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
