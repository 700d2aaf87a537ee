"""Exploration queries: splits by membership, shares, counts and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.operators.prefix import running_total, values_at


def membership(df: DataFrame, key: str, others: DataFrame, other_key: str, yes: str, no: str, flag: str) -> DataFrame:
    """Adds a two-valued flag: does the key occur in the other table."""
    present = others.select(F.col(other_key).alias(key)).distinct().withColumn("_in", F.lit(True))
    return df.join(present, key, "left").withColumn(flag, F.when(F.col("_in"), yes).otherwise(no)).drop("_in")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def share(totals: DataFrame, value: str, name: str = "percentage") -> DataFrame:
    """Adds the percentage of the grand total, highest first."""
    grand = totals.agg(F.sum(value).alias("grand")).scalar()
    return totals.withColumn(name, F.try_divide(100.0 * F.col(value), grand)).orderBy(F.col(value).desc())


def attach_counts(entities: DataFrame, key: str, rows: DataFrame, row_key: str, counted: str, name: str) -> DataFrame:
    """Adds to each entity how many rows refer to it, 0 for none."""
    counts = rows.groupBy(F.col(row_key).alias(key)).agg(F.count(counted).alias(name))
    return entities.join(counts, key, "left").na.fill(0, [name])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, count) over equal-width bins from minimum to maximum; the last bin is closed."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    per_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    width = F.col("width")
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    placed = per_value.withColumn("lo", lo).withColumn("width", (hi - F.col("lo")) / bins)
    return (
        placed.groupBy(place.cast("int").alias("bin"))
        .agg(F.sum("n").alias("count"), F.first("lo").alias("lo"), F.first("width").alias("width"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("low"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
            "count",
        )
    )


def boxplot(df: DataFrame, value: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 interquartile ranges, extremes and number of outliers.

    Values are counted first, and running counts over ranges of values tell which value stands
    at each place, so no task sees all distinct values. A quartile between two places is
    interpolated. NaN counts as larger than any number. No value gives nulls and no outliers.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    per_value = running_total(counted, "x", "n", "before")
    last = per_value.agg(F.sum("n").alias("rows")).select(F.col("rows") - 1).scalar()
    exact = [F.lit(q) * last for q in (0.25, 0.5, 0.75)]
    found = values_at(per_value, "x", "n", "before", [f(e) for e in exact for f in (F.floor, F.ceil)])
    bounds = per_value.agg(F.min("x").alias("low"), F.max("x").alias("high"))

    def quartile(i: int) -> Column:
        below, above = F.col(f"p{2 * i}").cast("double"), F.col(f"p{2 * i + 1}").cast("double")
        between = below + (above - below) * (exact[i] - F.floor(exact[i]))
        return F.when(below == above, below).otherwise(between)

    quartiles = found.crossJoin(bounds).select(
        quartile(0).alias("q1"), quartile(1).alias("median"), quartile(2).alias("q3"), "low", "high"
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(F.struct((F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi")).alias("f"))
    placed = per_value.withColumn("f", fences.scalar())
    inside = F.col("x").between(F.col("f.lo"), F.col("f.hi"))
    whiskers = placed.agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("outliers"),
    )
    box = quartiles.select(F.struct("q1", "median", "q3", "low", "high").alias("b"))
    return whiskers.withColumn("b", box.scalar()).select(
        "b.q1", "b.median", "b.q3", "b.low", "b.high", "whisker_low", "whisker_high", "outliers"
    )
