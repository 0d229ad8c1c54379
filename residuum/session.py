"""Session defaults shared by the bench and the tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every plan of the library relies on for results (time zone) or for scale (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session to every function instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("residuum")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": driver_memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The temporary folder of this process, once a local session without a shared one needs it.
_own: list[str] = []


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the folder that the cluster names in ``spark.checkpoint.dir`` and read it back; only a local master may be without one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="residuum-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    path = f"{folder.rstrip('/')}/residuum-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
