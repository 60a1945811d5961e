"""Session construction: the only place where engine-wide Spark settings live."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any scale; partition counts are left to AQE and the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "factloom", cores: int | str | None = None, **conf: str) -> SparkSession:
    """Return a session; `cores` builds a local one, None keeps the launcher's master."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "8g"))
        conf = {"spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8"} | conf
    for key, value in (BASE_CONF | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the same folders; a cluster that doesn't gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
