"""Tables in the folder that driver and executors share, and places of rows in groups of any size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Only used where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the one set by setCheckpointDir."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def stored(df: DataFrame, name: str, path: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, or to ``path``, and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a recomputation, and keeps
    a table that several later jobs read from being computed several times.
    """
    spark, own = df.sparkSession, path is None
    path = path or f"{shared_dir(spark).rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if own and (paths := _in_scratch.get()) is not None:
        paths[path] = out
    return out


#: Shuffle files of a table go when it is written: it is read back from the shared folder, never computed again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_in_scratch: ContextVar[dict[str, DataFrame] | None] = ContextVar("_in_scratch", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote within a ``scratch``; nothing that is still to be computed may read them."""
    paths = _in_scratch.get() or {}
    for path in [p for p, t in paths.items() if any(t is x for x in tables)]:
        _delete(paths.pop(path).sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``stored`` writes in the shared folder within the block are deleted at its end, but for those given to what it yields.

    These fall to a scratch around this one, if there is any. What leaves the block may read no other table of it.
    """
    outer, paths, kept = _in_scratch.get(), {}, []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    token = _in_scratch.set(paths)
    try:
        yield keep
    finally:
        _in_scratch.reset(token)
        for path, table in paths.items():
            if not any(table is x for x in kept):
                _delete(spark, path)
            elif outer is not None:
                outer[path] = table


def placed(df: DataFrame, groups: list[str], order: list, name: str, weight: str | None = None) -> DataFrame:
    """The table, stored, with ``_place`` (from 0) in the order of its group and ``_count``, the rows of the group.

    Rows are dealt and sorted by ranges, so a group of any size lies over many tasks; what is added up is one number
    for each group and range. Nulls are a group; rows that tie in all of ``order`` stand in any order. With a ``weight`` each
    row counts as many: its place is the weight of all before it, and it is unique in ``order``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    size = F.count("*") if weight is None else F.sum(weight)
    runs = rows.groupBy(*groups, "_part").agg(F.min("_at").alias("_from"), size.alias("_n"))
    of_group = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = runs.select(
        *(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_part").alias("_of_part"), F.col("_from").alias("_start"), before.alias("_before"), F.sum("_n").over(of_group).alias("_count")
    )
    same = F.col("_part") == F.col("_of_part")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    if weight is None:
        own = F.col("_at") - F.col("_start")
    else:  # within a range, which is as small as ranges are
        upto = Window.partitionBy(*groups, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows, own = rows.withColumn("_own", F.coalesce(F.sum(weight).over(upto), F.lit(0))), F.col("_own")
    out = rows.join(shifts, same).withColumn("_place", F.col("_before") + own)
    return out.drop("_at", "_part", "_start", "_before", "_of_part", "_own", *(f"_of_{g}" for g in groups))


#: Bytes of a row of bars or pairs; tables that the planner thinks smaller than a task's rows are not counted.
ROW_BYTES = 56
#: Columns of ``stretches``.
HALO, STRETCH = "__halo", "__stretch"


def has_long_groups(df: DataFrame, groups: list[str], rows: int) -> bool:
    """Whether a group has more than ``rows`` rows; counted in a pass of its own where the table may be so large."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < rows * ROW_BYTES:
        return False
    return (df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > rows


def stretches(df: DataFrame, groups: list[str], order: str, length: int, back: int, ahead: int, name: str) -> DataFrame:
    """The rows of each group cut into stretches of ``length`` rows in order, or of ``back`` or ``ahead`` if these are more.

    ``STRETCH`` numbers them; a stretch also gets, with ``HALO`` set, the last ``back`` rows before it and the first ``ahead`` rows after it. Also
    added are ``_place``, ``_count`` and ``__length``.
    """
    length = max(length, back, ahead)
    rows = placed(df, groups, [order], name).withColumn("__length", F.lit(length).cast("long"))
    own, at = F.call_function("div", F.col("_place"), F.col("__length")), F.col("_place") % length
    after = F.when((at >= length - back) & ((own + 1) * length < F.col("_count")), own + 1)
    before = F.when((at < ahead) & (own > 0), own - 1)

    def copy(number, halo: bool):
        return F.when(number.isNotNull(), F.struct(number.alias(STRETCH), F.lit(halo).alias(HALO)))

    return rows.select("*", F.inline(F.array_compact(F.array(copy(own, False), copy(after, True), copy(before, True)))))
