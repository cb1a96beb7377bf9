"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Lets this session's Python workers import the package from where the driver has it.

    Covers local mode and clusters that share that path; elsewhere install it or pass --py-files.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def local(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects: UTC, AQE, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("fathomline")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return importable(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver and executors share. Local sessions that name none get a temporary one, others an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="fathomline-")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage: a lost executor costs a re-read."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
