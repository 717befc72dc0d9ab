"""Spark sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: UTC makes epoch arithmetic exact; adaptive execution coalesces, splits skew and re-plans joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def make_session(master: str | None = None, app: str = "tarn", **settings: str) -> SparkSession:
    """A session; on a cluster give no master, so that the submit command decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir``, or for a local session without one a temporary folder."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tarn-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path
