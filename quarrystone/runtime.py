"""Session-level helpers shared by every operator: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored size from which a table is spread over the session's slots where it is read in fewer partitions.
SPREAD_BYTES = 1 << 20
#: Paths written by ``stored`` and not released yet.
_WRITTEN: list[str] = []
#: Largest serialised size a side may have before it is joined by shuffle instead of by broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Gives the session's executors this package, once, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrystone_shipped", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="quarrystone-")) / "quarrystone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("quarrystone") / f.relative_to(here))
    sc.addPyFile(str(path))
    sc._quarrystone_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory. Only columns selected later are read.

    A table that is read in fewer partitions than the session has slots is spread over all of them, as the work on its texts
    outweighs moving them.
    """
    ship(spark)
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    if plan_bytes(df) >= SPREAD_BYTES and df.rdd.getNumPartitions() < slots(spark):
        return df.repartition(slots(spark))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in local tests, a temporary folder of this machine is set; a
    session on a cluster without the setting is refused, as its executors could not read such a folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarrystone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder, so it survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a fresh path of the shared folder and read back with column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` has written for ``df``, if it is such a table, before the process ends: nothing may read it any more."""
    path = getattr(df, "_stored_at", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside are deleted as soon as it ends; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written in this process. Call it when the results of all queries are saved; else it is
    done when the process ends."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def _release_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        with suppress(Exception):  # the session may be gone
            release(spark)


atexit.register(_release_at_end)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if the optimizer's estimate is under ``limit``; otherwise as it is, so that
    the join shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as the session tells."""
    return max(1, spark.sparkContext.defaultParallelism)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the largest ``order`` (nulls smallest). Rows with equal order are
    interchangeable copies."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def prefix_offsets(
    df: DataFrame, group: str, order: list[str], amount: str, bucket: str, out: str
) -> DataFrame:
    """Adds ``out``: the inclusive running sum of ``amount`` over ``group`` ordered by (``bucket``, ``order``).

    A group may hold any share of the rows: sums for each (group, bucket) are taken first, their running
    totals are joined back, and only rows of one bucket of one group are ordered in a task.
    """
    from pyspark.sql import Window

    sums = df.groupBy(group, bucket).agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col(group).alias("_pf_group"), F.col(bucket).alias("_pf_bucket"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_pf_before")
    )
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_pf_in", F.sum(amount).over(inner)).join(
        before, (F.col(group) == F.col("_pf_group")) & (F.col(bucket) == F.col("_pf_bucket")), "inner"
    )
    return joined.withColumn(out, F.col("_pf_before") + F.col("_pf_in")).drop("_pf_group", "_pf_bucket", "_pf_before", "_pf_in")


def local_path_exists(path: str) -> bool:
    return os.path.exists(path.removeprefix("file://"))
