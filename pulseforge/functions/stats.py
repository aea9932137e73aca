"""Column expressions that guard against NaN, infinities, constants and rounding ties."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def settle(x: Column, digits: int = 6) -> Column:
    """Rounded, with ties moved the same way everywhere; null stays null."""
    return F.round(x + F.lit(1e-9), digits)


def over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def quantile(x: Column | str, q, w: WindowSpec | None = None) -> Column:
    """Exact interpolated percentile (or an array of them), also over ordered frames."""
    return over(F.percentile(x, q), w)


def safe_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over rows with both values; null for constants and single rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = over(F.stddev_pop(a), w) * over(F.stddev_pop(b), w)
    return over(F.covar_pop(a, b), w) / F.when(spread > 1e-300, spread)


def try_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)
