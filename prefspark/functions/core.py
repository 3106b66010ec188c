"""Scalar column helpers shared by all operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five reward attributes, in the column order the reward
# tables use (alphabetical).
ATTRIBUTES = ["coherence", "complexity", "correctness", "helpfulness", "verbosity"]

def nan() -> Column:
    """A NaN double literal (built lazily: literals need an active session)."""
    return F.lit(float("nan"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_ge(a, b) -> Column:
    """``a >= b`` with IEEE semantics: any NaN side compares false.

    Spark orders NaN above every number, so plain ``>=`` would call NaN a win.
    Null sides stay null (a missing cell, not a loss).
    """
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(a >= b)


def ieee_gt(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(a > b)


def ieee_lt(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(a < b)


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    if isinstance(p, str):
        return F.col(p).cast("string")
    return F.lit(str(p))


def hash_bigint(*parts) -> Column:
    """First 32 bits of md5(concat_ws('|', parts)) as a non-negative bigint.

    Deterministic across engines, so a seeded decision can be replayed in SQL.
    """
    s = F.concat_ws("|", *[_part(p) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def coin(seed: int, *parts) -> Column:
    """Seeded fair coin in {0, 1} from the md5 hash of (seed, parts...)."""
    return (hash_bigint(F.lit(str(seed)), *parts) % 2).cast("int")


def sigmoid(x) -> Column:
    x = _c(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x) -> Column:
    """Numerically stable log(sigmoid(x)) = min(x, 0) - log1p(exp(-|x|))."""
    x = _c(x)
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def clamp(x, low=None, high=None) -> Column:
    """min/max bounds that keep NaN (and null) as it is, unlike ``least``/``greatest``."""
    x = _c(x)
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(y)


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {df.columns}")
    return df
