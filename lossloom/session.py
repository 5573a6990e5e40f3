"""Session settings the engine expects."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


#: Settings of a local session for tests and the bench; whatever the submit command or its defaults set stays.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lossloom", cores: int | None = None, memory: str = "16g") -> SparkSession:
    """The session; only settings that nobody has set are filled in."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    given = SparkConf()
    wanted = DEFAULTS | {"spark.master": f"local[{cores}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores)}
    builder = SparkSession.builder.appName(app)
    for key, value in wanted.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    return builder.getOrCreate()
