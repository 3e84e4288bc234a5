"""Scalar functions on numbers and on text that should hold one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellsight.functions import as_column as _c

HAS_DIGIT, NO_NUMBER = "[0-9]", r"[^0-9a-fA-FxXpP+\-.\s\x00-\x20\x7f-\x9f]"


def number(value) -> Column:
    """The value as a double; null if it doesn't parse or isn't a number.

    Texts without a digit, or with a character that no number has, are set aside first: a failed cast is slow.
    """
    v = _c(value)
    may = v.rlike(HAS_DIGIT) & ~v.rlike(NO_NUMBER) | v.rlike("(?i)inf")
    d = F.when(may, v).try_cast("double")
    return F.when(~F.isnan(d), d)


def number_or_zero(value) -> Column:
    return F.coalesce(number(value), F.lit(0.0))


def comma_number(value) -> Column:
    """A number with a decimal comma."""
    return number(F.replace(_c(value), F.lit(","), F.lit(".")))


def quoted_label(value) -> Column:
    """A class label in single quotes, as an integer."""
    return F.btrim(_c(value), F.lit("'")).try_cast("int")


def mask_value(value) -> Column:
    """A mask cell as an integer; what doesn't parse is 0."""
    return F.coalesce(_c(value).try_cast("double").cast("int"), F.lit(0))


def sign_of(value) -> Column:
    return F.signum(_c(value)).cast("int")


def relative_change(old, new) -> Column:
    """|new - old| / (|old| + 1)"""
    return F.abs(_c(new) - _c(old)) / (F.abs(_c(old)) + 1)


def signed_relative_change(old, new, eps: float = 1e-10) -> Column:
    return (_c(new) - _c(old)) / (_c(old) + F.lit(eps))


def scaled_change(reference, observed, eps: float = 1e-9) -> Column:
    """|observed - reference| / (|reference| + eps)"""
    return F.abs(_c(observed) - _c(reference)) / (F.abs(_c(reference)) + F.lit(eps))


def weighted_change(reference, observed, sigma, alpha: float = 1.0, eps: float = 1e-9) -> Column:
    """Change over the reference, discounted by the reference's uncertainty."""
    return F.abs(_c(observed) - _c(reference)) / (F.abs(_c(reference)) * (1 + F.lit(alpha) * _c(sigma)) + F.lit(eps))


def weighted_edit(share, sigma, alpha: float = 1.0) -> Column:
    return _c(share) / (1 + F.lit(alpha) * _c(sigma))


def confidence(sigma) -> Column:
    return 1 / (1 + _c(sigma))


def z_score(value, mean, std) -> Column:
    return (_c(value) - _c(mean)) / F.nullif(_c(std), F.lit(0.0))


def centrality(value, mean, std, cap: float = 3.0) -> Column:
    """1 at the mean, 0 from ``cap`` deviations on; a constant column gives 1, no column statistics or no number 0."""
    inside = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.abs((_c(value) - _c(mean)) / F.nullif(_c(std), F.lit(0.0))) / F.lit(cap)))
    return F.when(_c(mean).isNull(), 0.0).when(_c(std) == 0, 1.0).otherwise(F.coalesce(inside, F.lit(0.0)))


def rank_score(rank, size) -> Column:
    """1 for the most frequent value down to 0 for an unknown one (rank null)."""
    score = F.greatest(F.lit(0.0), 1 - (F.coalesce(_c(rank), _c(size) + 1) - 1) / F.greatest(F.lit(1), _c(size)))
    return F.when(F.coalesce(_c(size), F.lit(0)) == 0, 0.0).otherwise(score)


def position(value, low, high) -> Column:
    """Where a value lies between the least and the greatest; 0.5 if these are equal."""
    return F.when(_c(high) > _c(low), (_c(value) - _c(low)) / (_c(high) - _c(low))).otherwise(0.5)


def sigmoid(value) -> Column:
    return 1 / (1 + F.exp(-_c(value)))


def clip(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(value)))
