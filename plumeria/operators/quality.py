"""Row-level data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.functions.dates import parses_as_day
from plumeria.functions.text import (
    MIN_USERNAME_LENGTH,
    is_email,
    is_strong_password,
    is_username,
)


def valid_days(df: DataFrame, c: str = "dt") -> DataFrame:
    """Rows whose text date parses; leftovers of a merge conflict go with the rest."""
    return df.where(parses_as_day(c))


def duplicated(df: DataFrame, c: str) -> DataFrame:
    """Values of a column that occur more than once."""
    return df.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1").select(c)


def failed_rules(accounts: DataFrame, password: str | None = None) -> DataFrame:
    """Accounts with an array of the sign-up rules they break."""
    repeated = {
        c: duplicated(accounts, c).withColumn(f"_repeated_{c}", F.lit(True)) for c in ("email", "username")
    }
    checked = accounts
    for c, values in repeated.items():
        checked = checked.join(values, c, "left")
    rules = [
        F.when(~F.coalesce(is_email("email"), F.lit(False)), "email"),
        F.when(F.col("_repeated_email"), "email repeated"),
        F.when(~F.coalesce(is_username("username"), F.lit(False)), "username"),
        F.when(F.col("_repeated_username"), "username repeated"),
        F.when(F.length("username") < MIN_USERNAME_LENGTH, "username length"),
    ]
    if password is not None:
        rules.append(F.when(~F.coalesce(is_strong_password(password), F.lit(False)), "password"))
    return checked.withColumn("failed", F.array_compact(F.array(*rules))).drop("_repeated_email", "_repeated_username")


def search(accounts: DataFrame, c: str, text: str) -> DataFrame:
    """Rows whose column contains the text, in order of that column."""
    return accounts.where(F.col(c).contains(text)).orderBy(c)


def lookup(keys: DataFrame, accounts: DataFrame, key: str, value: str) -> DataFrame:
    """The value per key, an empty text where the key is unknown."""
    return keys.join(accounts.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit("")))
