"""Text expressions: account rules, formatting, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeria.functions.dates import column

# Account rules that must equal the existing sign-up form.
EMAIL_PATTERN = r"^[a-zA-Z0-9-_]+@[a-zA-Z0-9]+\.[a-z]{1,3}$"
USERNAME_PATTERN = r"^[a-zA-Z0-9]*$"
MIN_USERNAME_LENGTH = 2
MIN_PASSWORD_LENGTH = 8
PASSWORD_PATTERNS = [r"[A-Z]", r"[a-z]", r"\d", r"[!@#$%^&*]"]
MAX_FEEDBACK_LENGTH = 500


def full_text(title: str | Column, caption: str | Column) -> Column:
    """Title and caption in one text; null when either is null."""
    return F.concat(column(title), F.lit(" "), column(caption))


def is_email(c: str | Column) -> Column:
    return column(c).rlike(EMAIL_PATTERN)


def is_username(c: str | Column) -> Column:
    return column(c).rlike(USERNAME_PATTERN)


def is_strong_password(c: str | Column) -> Column:
    strong = F.length(column(c)) >= MIN_PASSWORD_LENGTH
    for pattern in PASSWORD_PATTERNS:
        strong = strong & column(c).rlike(pattern)
    return strong


def password_digest(c: str | Column) -> Column:
    """Hex SHA-256 of a text column."""
    return F.sha2(column(c), 256)


def percent_text(c: str | Column, digits: int = 2) -> Column:
    """A ratio as percent text, such as ``12.50%``."""
    return F.format_string(f"%.{digits}f%%", column(c) * 100)


def decimal_text(c: str | Column, digits: int = 2) -> Column:
    """A number with thousands separators and fixed decimals."""
    return F.format_number(column(c), digits)


def fresh_id() -> Column:
    return F.uuid()
