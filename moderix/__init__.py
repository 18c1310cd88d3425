"""Analytics of short-text moderation data, and corpus operators, on Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster ships it with --py-files), and bound the bytes of
    the Arrow batches that they get more narrowly than Spark does, unless the session says otherwise."""
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), here) if x)
    if spark.conf.get(BATCH_BYTES, None) in (None, f"{64 << 20}b", f"{(1 << 31) - 1}b"):  # Spark's defaults
        spark.conf.set(BATCH_BYTES, str(2 << 20))
