"""The session: UTC, adaptive execution, and the one shared folder for anything that must survive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local(cpus: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("engine").config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared folder that the session names in spark.checkpoint.dir.

    Where it is unset (a local test), a temporary folder of the machine is set as that folder, once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='engine-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
