"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_stored, placed, scratch, shared_dir
from ..shared import stored as materialize

__all__ = ["boxed", "drop_stored", "materialize", "placed", "read", "scratch", "shared_dir", "sliced", "unboxed", "uniform", "word_count"]

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A reproducible number in [0, 1) from the values of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def boxed(df: DataFrame, *leave_out: str) -> Column:
    """All columns in one, named _row, so that names of an operator's own cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in leave_out)).alias("_row")


def unboxed(names: list[str]) -> list[Column]:
    return [F.col(f"_row.`{n}`").alias(n) for n in names]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without a copy: what Python makes of a batch of texts, and holds, is a small part of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
