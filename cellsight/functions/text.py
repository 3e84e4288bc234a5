"""Scalar functions on cell text and on column names.

Column functions stay in the JVM. Functions on names (a few strings of a schema) are plain Python.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellsight.functions import as_column as _c

#: Fixed values.
NULL_STRINGS = ("nan", "none", "")
OBFUSCATION_TOKENS = (
    "nan", "none", "n/a", "na", "unknown", "unk", "?", "—", "-", "--", "null", "nil", "missing", "not available",
    "not applicable", "0", "-1", "999", "9999", "99999",
)
FINGERPRINT_OBFUSCATION_TOKENS = ("unknown", "n/a", "na", "—", "-", "?", "none", "null", "nan", "not available", "not specified", "other", "unspecified")
OBFUSCATION_SEPARATORS = ("-", "_", " ")
OBFUSCATION_SUFFIXES = ("dmv", "obf", "high", "low", "1", "2", "x", "?", "—")
SENSITIVE_KEYWORDS = ("race", "gender", "sex", "age", "nationality", "religion", "disability", "marital", "ethnic", "origin", "orientation")
IMMUTABLE_KEYWORDS = ("id", "num", "wgt", "weight", "score", "code", "key", "index", "ssn", "hash", "uuid", "timestamp", "date", "time")
PROTECTED_KEYWORDS = ("race", "gender", "sex", "nationality", "religion", "disability", "ethnicity")
EDIT_CAP = 10


def is_null_string(value) -> Column:
    """Null, or one of the strings that stand for null, in any case."""
    v = _c(value)
    return v.isNull() | F.lower(F.trim(v)).isin(*NULL_STRINGS)


def edit_distance_capped(a, b, cap: int = EDIT_CAP) -> Column:
    """Levenshtein distance, ``cap`` for anything from there up."""
    d = F.levenshtein(_c(a), _c(b), cap - 1)
    return F.when(d < 0, F.lit(cap)).otherwise(d)


def edit_distance(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def edit_share(a, b) -> Column:
    """Distance over the longer length (at least 1)."""
    return edit_distance(a, b) / F.greatest(F.char_length(_c(a)), F.char_length(_c(b)), F.lit(1))


def is_obfuscation_token(value, tokens=OBFUSCATION_TOKENS) -> Column:
    return F.lower(F.trim(_c(value))).isin(*tokens)


def is_placeholder(value) -> Column:
    """One character, or nothing that is a letter or a digit; not for the empty string."""
    v = F.trim(_c(value))
    return (F.char_length(v) > 0) & ((F.char_length(v) == 1) | ~v.rlike(r"[\p{L}\p{N}]"))


def has_obfuscation_suffix(value, base) -> Column:
    """``value`` is ``base``, a separator and a known suffix."""
    v, b = F.lower(_c(value)), F.lower(_c(base))
    rest = F.substring(v, F.char_length(b) + 1, F.char_length(v))
    return v.startswith(b) & F.substring(rest, 1, 1).isin(*OBFUSCATION_SEPARATORS) & F.substring(rest, 2, 64).isin(*OBFUSCATION_SUFFIXES)


def typo_score(value) -> Column:
    """0.3 for each ``aba`` and each ``aaa``, at most 1; 0 up to two characters."""
    v = F.lower(F.trim(_c(value)))
    at = lambda i: F.substring(v, i, F.lit(1))
    n = F.char_length(v)
    hits = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when(at(i) == at(i + 2), F.lit(1)).otherwise(F.lit(0)),
    )
    return F.when(n <= 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), hits * F.lit(0.3)))


def length_anomaly(value, median_length) -> Column:
    return F.abs(F.char_length(_c(value)) - _c(median_length)) / (_c(median_length) + 1)


def has_digit(value) -> Column:
    return _c(value).rlike(r"\d")


def has_special(value) -> Column:
    return _c(value).rlike(r"[^\w\s\-.]")


def prefix_key(value, n: int = 4) -> Column:
    return F.substring(_c(value), 1, n)


def feature_kind(name) -> Column:
    """Kind of a column by its name; the last rule that holds wins."""
    n = F.lower(_c(name))
    return F.when(n.startswith("has_"), "flag").when(n.contains("count"), "count").when(n.contains("length"), "length").otherwise("other")


# names of columns --------------------------------------------------------------


def clean_name(name: str) -> str:
    """Lower case without separators, digits and the words num, no and id."""
    words = re.sub(r"[-_]", " ", name.lower())
    words = re.sub(r"\b(?:num|no|id)\b", "", words)
    return " ".join(re.sub(r"\d+", "", words).split())


def similar_names(columns: list[str], ratio: float = 0.8) -> set[tuple[str, str]]:
    """Pairs (sorted) of columns whose clean names are alike."""
    names = [(clean_name(c), c) for c in columns]
    alike = lambda a, b: a and b and difflib.SequenceMatcher(None, a, b).ratio() >= ratio
    return {tuple(sorted((c, d))) for i, (a, c) in enumerate(names) for b, d in names[i + 1 :] if alike(a, b)}


def comprehensibility(name: str) -> float:
    """0 for short names or digits, 0.3 with an abbreviation, 1 for several words, else 0.8."""
    words = re.split(r"[-_\s]+", name.lower().strip("-_ "))
    if len(name) < 4 or any(ch.isdigit() for ch in name):
        return 0.0
    if any(len(w) <= 3 or not set(w) & set("aeiou") for w in words):
        return 0.3
    return 1.0 if len(words) > 1 else 0.8


def mutability(name: str) -> float:
    """0 for names of assigned values, 0.5 for protected attributes, else 1."""
    lower = name.lower()
    solid = re.sub(r"[-_ ]", "", lower)
    return 0.0 if any(k in solid for k in IMMUTABLE_KEYWORDS) else 0.5 if any(k in lower for k in PROTECTED_KEYWORDS) else 1.0


def is_sensitive(name: str) -> bool:
    return any(k in name.lower() for k in SENSITIVE_KEYWORDS)
