"""Token estimates of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token: 3.4 for prose-like code, less a margin of 1.3 so that estimates rather exceed.
CHARS_PER_TOKEN = round(3.4 / 1.3, 2)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def estimate(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """floor(characters that are no newlines / constant) + newlines + 1; 0 of an empty text."""
    body = F.length(text) - newlines(text)
    found = F.floor(body / F.lit(float(chars_per_token))) + newlines(text) + 1
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(found).cast("long")


def estimator(chars_per_token: float):
    """A column function with a constant of one's own, as calibration gives it."""
    return lambda text: estimate(text, chars_per_token)


def estimate_text(text: str, chars_per_token: float = CHARS_PER_TOKEN) -> int:
    """The same for one text on the driver."""
    if not text:
        return 0
    lines = text.count("\n")
    return int((len(text) - lines) / chars_per_token) + lines + 1


def calibrated_constant(samples, tokens: str = "tokens", text: str = "text"):
    """chars_per_token from counted samples: pooled characters over pooled tokens less lines; null without samples."""
    body = F.sum(F.length(text) - newlines(F.col(text)))
    return samples.agg(F.try_divide(body, F.sum(F.col(tokens) - newlines(F.col(text)) - 1)).alias("chars_per_token"))
