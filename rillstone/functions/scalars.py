"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[ \t\n\x0B\f\r]+"


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_loss(x: Column) -> Column:
    return F.log1p(F.exp(-x))


def logistic_grad(x: Column) -> Column:
    return -1 / (1 + F.exp(x))


def ascii_lower(text: Column) -> Column:
    """A-Z alone; `lower` would fold other alphabets too."""
    return F.translate(text, UPPER, LOWER)


def tokens(line: Column) -> Column:
    """Lower-cased tokens between ASCII white space, without empty ones."""
    return F.filter(F.split(ascii_lower(line), WHITE), lambda t: t != "")


def normal_label(label: Column) -> Column:
    return F.when(label == -1, 0).otherwise(label)


def finite(x: Column) -> Column:
    """The number, or null where JSON has none (NaN and infinities)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def checked_key(key: Column, dim: int) -> Column:
    """The key; an error where it lies outside [0, dim)."""
    return F.when((key >= 0) & (key < dim), key).otherwise(F.raise_error(F.concat(F.lit("key out of range: "), key.cast("string"))).cast("bigint"))
