"""Keyed writes as DataFrame algebra: upsert, insert-only, delete, incremental merge."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.operators.series import latest_per


def dedupe_latest(df: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """The newest row per key; equal times are settled by the remaining columns."""
    rest = [c for c in df.columns if c not in {*keys, when}]
    newest = df.groupBy(*keys).agg(F.max(F.struct(when, *rest)).alias("_row"))
    return newest.select(*keys, f"_row.{when}", *[f"_row.{c}" for c in rest]).select(*df.columns)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the largest by the remaining columns, so repeats settle the same way every time."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return kept.select(*keys, *[f"_row.{c}" for c in rest]).select(*df.columns)


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    mode: str = "update",
) -> DataFrame:
    """``old`` with ``new`` merged on ``keys``; ``new`` must be unique on them.

    ``update`` names the columns a match may change (all by default), and
    ``mode='insert_only'`` leaves matched rows as they are.
    """
    if mode == "insert_only":
        return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))
    if mode != "update":
        raise ValueError(f"unknown mode {mode!r}")
    changed = [c for c in old.columns if c not in keys] if update is None else list(update)
    if set(changed) | set(keys) == set(old.columns):
        kept = old.join(new.select(*keys), list(keys), "left_anti")
        return kept.unionByName(new.select(*old.columns))
    incoming = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    updated = old.join(incoming, list(keys), "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in old.columns
        ]
    )
    added = new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns)
    return updated.unionByName(added)


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def high_water_mark(existing: DataFrame, when: str) -> str | None:
    """Newest time in the snapshot, as text. One value, read eagerly so that the filter
    built from it is a literal the source can apply."""
    return existing.agg(F.max(when).cast("string")).first()[0]


def new_rows(source: DataFrame, when: str, mark: str | None) -> DataFrame:
    """Rows after the mark; the mark takes the column's own type, so the column stays bare."""
    if mark is None:
        return source
    return source.where(F.col(when) > F.lit(mark).cast(source.schema[when].dataType))


def unseen_rows(source: DataFrame, existing: DataFrame, key: str, when: str, lateness: timedelta) -> DataFrame:
    """Rows from the mark, less ``lateness``, on that the snapshot doesn't hold as new or newer.

    Both sides are read from that time on only, which is a literal in their filters.
    """
    mark = high_water_mark(existing, when)
    if mark is None:
        return source
    since = (datetime.fromisoformat(mark) - lateness).isoformat(sep=" ")
    recent = [df.where(F.col(when) >= F.lit(since).cast(df.schema[when].dataType)) for df in (source, existing)]
    stored = recent[1].groupBy(F.col(key).alias("_key")).agg(F.max(when).alias("_when"))
    same = (F.col(key) == F.col("_key")) & (F.col(when) <= F.col("_when"))
    return recent[0].join(stored, same, "left_anti")


def merge_delta(existing: DataFrame, delta: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """Snapshot plus delta, newest row per key, wherever it comes from. Keys outside the delta are only filtered."""
    named = delta.select(*keys).distinct()
    stored = existing.join(named, list(keys), "left_semi").select(*existing.columns)
    newest = dedupe_latest(stored.unionByName(delta.select(*existing.columns)), keys, when)
    return existing.join(named, list(keys), "left_anti").select(*existing.columns).unionByName(newest)


def validated_feedback(rows: DataFrame, limit: int) -> DataFrame:
    """Feedback rows with the reason for rejection, null when accepted."""
    reason: Column = F.when(F.col("feedback").isNull() | F.col("rating").isNull(), "missing value").when(
        F.length("feedback") > limit, "feedback too long"
    )
    return rows.withColumn("reject_reason", reason)


def latest_snapshot(log: DataFrame, key: str, when: str) -> DataFrame:
    """The newest append per key of a log that only grows; of equal times the largest by the other columns."""
    rest = [F.col(c).desc() for c in log.columns if c not in (key, when)]
    return latest_per(log, [key], [F.col(when).desc(), *rest])
