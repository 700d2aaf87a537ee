"""Small helpers that the operators share: tables, ids, words as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm.words import CHUNK_BYTES, chunks

#: A side is broadcast up to this many rows of a few numbers each; above, Spark joins it by shuffle.
BROADCAST_ROWS = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % modulus


def by_chunk(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int = CHUNK_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands `work` runs of rows of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, column, most):
                done = work(chunk)
                if done is not None and done.num_rows:
                    yield done

    return run


def bounded_broadcast(side: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only for a side counted as small; else Spark chooses the join."""
    return F.broadcast(side) if rows <= most else side
