"""Session helpers: local sessions for tests and benches, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "plumeria", memory: str = "8g") -> SparkSession:
    """A loopback-bound ``local[n]`` session with UTC time and AQE."""
    partitions = "8" if cpus == "*" else str(cpus)
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would not survive the loss of its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="plumeria-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name next to the checkpoints, where every executor can write."""
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so lost executors cost no replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(spark: SparkSession, work: Sequence[Callable[[], Any]]) -> list[Any]:
    """What each function returns. Their jobs share the cores, so that one fills what the small stages of others leave idle.

    All are ended before the first error, in the order given, is raised.
    """
    checkpoint_dir(spark)  # before any thread sets its own
    with ThreadPoolExecutor(max(1, len(work))) as threads:
        started = [threads.submit(inheritable_thread_target(spark)(each)) for each in work]
    return [each.result() for each in started]
