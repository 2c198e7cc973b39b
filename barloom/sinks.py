"""Storing a run: the feature table, a catalogue of its columns and a summary; and reading runs back."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .compute import resolve_feature, selected_feature_configs
from .schema import IDS

STEM = re.compile(r"features_v(.*)_(\d{8}_\d{6}_\d{6})")


def rows_per_symbol(df: DataFrame) -> DataFrame:
    """(symbol, rows), without null symbols."""
    return df.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.count("*").alias("rows"))


def health_metrics(names: list[str]) -> list[Column]:
    """Nulls, least, mean and greatest of each column, named by its number."""
    out = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        out += [F.count_if(c.isNull()).alias(f"nulls_{i}"), F.min(c).cast("double").alias(f"min_{i}"), F.avg(c).alias(f"mean_{i}"), F.max(c).cast("double").alias(f"max_{i}")]
    return out


def feature_health(df: DataFrame) -> DataFrame:
    """(feature, null_count, null_pct, min, mean, max) of every column but the ids, from one aggregate over the table."""
    names = [c for c in df.columns if c not in IDS]
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, null_count long, null_pct double, min double, mean double, max double")
    stats = [
        F.struct(
            F.lit(n).alias("feature"), F.col(f"nulls_{i}").alias("null_count"), F.round(F.try_divide(f"nulls_{i}", "rows"), 4).alias("null_pct"),
            F.col(f"min_{i}").alias("min"), F.col(f"mean_{i}").alias("mean"), F.col(f"max_{i}").alias("max"),
        ) for i, n in enumerate(names)
    ]
    return df.agg(F.count("*").alias("rows"), *health_metrics(names)).select(F.inline(F.array(*stats)))


def observed_health(names: list[str], seen: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """The health of each column from the metrics of the pass that wrote it."""
    rows = seen["rows"]
    return {
        n: {"null_count": seen[f"nulls_{i}"], "null_pct": round(seen[f"nulls_{i}"] / rows, 4) if rows else None, "min": seen[f"min_{i}"], "mean": seen[f"mean_{i}"], "max": seen[f"max_{i}"]}
        for i, n in enumerate(names)
    }


def feature_catalog(config: dict[str, Any], columns: list[str]) -> list[dict[str, Any]]:
    """What each active feature column of a table is."""
    out = []
    for item in selected_feature_configs((config or {}).get("features", {})):
        name, spec, params = resolve_feature(item)
        if name in columns:
            out.append({"name": name, "function": spec.name, "category": spec.category, "lookback": spec.resolve_lookback(params),
                        "description": spec.description, "calculation": spec.calculation})
    return out


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark reaches, put in its place when it is whole."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not put {path} in its place")


def save_features(df: DataFrame, config: dict[str, Any], report: dict[str, Any] | None = None, single_file: bool = False) -> dict[str, str]:
    """Write the table once per format, the catalogue and the summary; returns their paths.

    The features are computed for the first format only: the others and the rows of each symbol are taken from what was written. Health and rows
    are counted by the tasks that write. The summary comes last and is the run's commit record: a run without one is not whole, and ``load_features`` passes it over.
    """
    spark, run = df.sparkSession, config["run"]
    out_dir = run["output_dir"].rstrip("/")
    now = dt.datetime.now(dt.timezone.utc)
    version, stamp = run.get("version", "dev"), f"{now:%Y%m%d_%H%M%S_%f}"
    stem = f"features_v{version}_{stamp}"
    names = [c for c in df.columns if c not in IDS]
    seen, paths = Observation(), {}
    written = None
    for kind in sorted(run["output_formats"], reverse=True):  # Parquet, which keeps all values, before CSV
        paths[kind] = f"{out_dir}/{stem}.{kind}"
        ordered = (df if written is None else written).orderBy("symbol", "timestamp")
        ordered = ordered.coalesce(1) if single_file else ordered
        if written is None:  # above the sort, in the stage that writes: each task's share counts once
            ordered = ordered.observe(seen, F.count("*").alias("rows"), *health_metrics(names))
        if kind == "csv":
            ordered.write.option("header", True).csv(paths[kind])
        else:
            ordered.write.parquet(paths[kind])
        written = written if written is not None else read_table(spark, paths[kind], df.schema)
    catalog = feature_catalog(config, df.columns)
    paths["catalog_csv"] = f"{out_dir}/feature_catalog.csv"
    write_text(spark, paths["catalog_csv"], _csv(catalog, ["name", "function", "category", "lookback", "description", "calculation"]))
    per_symbol = {r["symbol"]: r["rows"] for r in rows_per_symbol(written).collect()}
    summary = {
        "generated_at": now.isoformat(), "rows": seen.get["rows"], "columns": df.columns,
        "features": names, "rows_per_symbol": per_symbol, "feature_health": observed_health(names, seen.get),
        "config": config, "cleaning": report, "outputs": dict(paths),
    }
    paths["summary_json"] = f"{out_dir}/{record_of(stem)}"
    write_text(spark, paths["summary_json"], json.dumps(summary, indent=2, default=str))
    return paths


def record_of(stem: str) -> str:
    """The name of a run's summary, which is written last."""
    return f"run_summary_v{stem.removeprefix('features_v')}.json"


def _csv(rows: list[dict[str, Any]], header: list[str]) -> str:
    import csv
    import io

    out = io.StringIO()
    writer = csv.DictWriter(out, header)
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if schema is not None:
        return spark.read.option("header", True).schema(schema).csv(path)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("symbol"), F.col("timestamp").cast("timestamp_ntz"), *(F.col(c).cast("double") for c in raw.columns if c not in IDS))


def load_features(spark: SparkSession, output_dir: str, run_stem: str | None = None, file_format: str = "parquet") -> DataFrame:
    """A stored run: the one named, else the newest by its time stamp of those that are whole."""
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unsupported file format {file_format!r}")
    if run_stem is None:
        p, fs = _path(spark, output_dir)
        names = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
        runs = [(m[2], n) for n in names if n.endswith(f".{file_format}") and (m := STEM.match(n)) and record_of(n.removesuffix(f".{file_format}")) in names]
        if not runs:
            raise FileNotFoundError(f"no stored {file_format} features in {output_dir}")
        run_stem = max(runs)[1].removesuffix(f".{file_format}")
    return read_table(spark, f"{output_dir.rstrip('/')}/{run_stem}.{file_format}")
