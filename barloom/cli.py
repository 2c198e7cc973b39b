"""The batch run: python -m barloom.cli --config config.toml"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from typing import Any

from pyspark.sql import SparkSession

from .compute import compute_features
from .config import validate_config
from .quality import clean_rows
from .sinks import save_features
from .sources import land_bars

log = logging.getLogger("barloom")


def load_config(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def session() -> SparkSession:
    return SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run_pipeline(config: dict[str, Any], spark: SparkSession | None = None) -> dict[str, str]:
    """Validate, load, clean, compute and store; the paths of what was written."""
    validate_config(config)
    spark = spark or session()
    bars, report = land_bars(spark, config)
    clean = clean_rows(bars, config.get("data_quality"))
    if not report["initial_rows"]:
        raise ValueError("no bars were loaded for this configuration")
    if not report["final_rows"]:
        raise ValueError("cleaning dropped every bar")
    paths = save_features(compute_features(clean, config), config, report)
    log.info("cleaning: %s", report)
    for kind, path in paths.items():
        log.info("wrote %s: %s", kind, path)
    return paths


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Compute features of market bars.")
    parser.add_argument("--config", required=True)
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    args = parser.parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    try:
        run_pipeline(load_config(args.config))
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
