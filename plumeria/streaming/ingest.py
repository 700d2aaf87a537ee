"""Incremental ingestion as a stream: new source files merge into a keyed snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from plumeria.operators.keyed import dedupe_latest, merge_delta
from plumeria.session import cut_lineage
from plumeria.sources.tables import read_if_present


def merge_into(
    spark: SparkSession, path: str, keys: Sequence[str], when: str
) -> Callable[[DataFrame, int], None]:
    """A batch function that merges rows by key, newest first. Merging a batch twice changes nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        if batch.isEmpty():
            return
        stored = read_if_present(lambda: spark.read.parquet(path))
        merged = dedupe_latest(batch, keys, when) if stored is None else merge_delta(stored, batch, keys, when)
        cut_lineage(merged).write.mode("overwrite").parquet(path)

    return write
