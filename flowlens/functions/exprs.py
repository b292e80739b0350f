"""Column-expression helpers shared by the operators.

Everything here returns a `Column`; nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = "Column | str"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, on_zero: str = "zero") -> Column:
    """num / den with the zero-denominator rule made explicit.

    on_zero: 'numerator' -> num, 'zero' -> 0, 'one' -> num / 1.
    A denominator counts as zero when it is NULL or <= 0.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    if on_zero == "numerator" or on_zero == "one":
        fallback = n
    elif on_zero == "zero":
        fallback = F.lit(0.0)
    else:
        raise ValueError(f"unknown on_zero rule {on_zero!r}")
    return F.when(d > 0, n / d).otherwise(fallback)


def safe_rate(num, duration) -> Column:
    """num / duration, 0 when duration is not positive."""
    return ratio(num, duration, "zero")


def round3(c) -> Column:
    """Half-up rounding to 3 decimals written the same way in DuckDB.

    `round` differs between engines on ties; floor(x*1000+0.5)/1000 does not.
    """
    return F.floor(col(c) * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def clamp01(c, lo, hi) -> Column:
    """Min-max scale into [0, 1], clipped; 0 when hi <= lo."""
    x = col(c).cast("double")
    lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    scaled = (x - lo_c) / (hi_c - lo_c)
    return F.when(hi_c > lo_c, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def digits_int(c, default: int = 0) -> Column:
    """Digit-guarded integer: '^[0-9]+$' -> BIGINT, else default."""
    s = F.trim(col(c).cast("string"))
    return F.coalesce(F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint")), F.lit(default)).cast("bigint")


def ipv4_to_long(c) -> Column:
    """Dotted IPv4 -> BIGINT; NULL when the text is not four octets 0..255."""
    s = col(c).cast("string")
    parts = F.split(s, r"\.")
    octs = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    valid = s.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    for o in octs:
        valid = valid & (o <= 255)
    value = octs[0] * 16777216 + octs[1] * 65536 + octs[2] * 256 + octs[3]
    return F.when(valid, value)


def zero_if_not_finite(c) -> Column:
    """+-inf / NaN / NULL -> 0.0."""
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


# ---------------------------------------------------------------- exact moments
# Mean / population variance / std of an integer column from exact integer
# sums: count and sum as BIGINT, the sum of squares as BIGINT for small values
# (packet sizes) and DECIMAL(38,0) else (gaps in microseconds). The sums are
# algebraic, so they combine map-side before any shuffle; and being exact they
# give the same bits whatever the partitioning or the engine (the DuckDB twin
# uses HUGEINT), unlike floating running sums.

def moment_aggs(x, name: str, small: bool = False) -> list[Column]:
    v = col(x).cast("bigint")
    w = v if small else v.cast("decimal(18,0)")
    return [F.count(v).alias(f"_{name}_n"), F.sum(v).alias(f"_{name}_s1"),
            F.sum(w * w).alias(f"_{name}_s2")]


def _spread_of(name: str) -> Column:
    """n * sum of squares - square of the sum, exactly."""
    n, s1, s2 = (F.col(f"_{name}_{s}").cast("decimal(38,0)") for s in ("n", "s1", "s2"))
    return (n * s2 - s1 * s1).cast("double")


def m_mean(name: str, scale: float = 1.0) -> Column:
    n, s1 = F.col(f"_{name}_n"), F.col(f"_{name}_s1")
    m = F.when(n > 0, s1.cast("double") / n.cast("double"))
    return m if scale == 1.0 else m / F.lit(float(scale))


def m_var(name: str, scale: float = 1.0) -> Column:
    n = F.col(f"_{name}_n")
    nd = n.cast("decimal(38,0)")
    v = F.when(n > 0, _spread_of(name) / (nd * nd).cast("double"))
    return v if scale == 1.0 else v / F.lit(float(scale) * float(scale))


def m_std(name: str, scale: float = 1.0) -> Column:
    n = F.col(f"_{name}_n")
    nd = n.cast("decimal(38,0)")
    s = F.when(n > 0, F.sqrt(_spread_of(name) / (nd * nd).cast("double")))
    return s if scale == 1.0 else s / F.lit(float(scale))


def sql_moments(x: str, name: str) -> str:
    return (f"count({x}) AS _{name}_n, sum(CAST({x} AS HUGEINT)) AS _{name}_s1, "
            f"sum(CAST({x} AS HUGEINT) * CAST({x} AS HUGEINT)) AS _{name}_s2")


def sql_mean(name: str, scale: float = 1.0) -> str:
    e = f"(CASE WHEN _{name}_n > 0 THEN CAST(_{name}_s1 AS DOUBLE) / CAST(_{name}_n AS DOUBLE) END)"
    return e if scale == 1.0 else f"({e} / {float(scale)!r})"


def sql_var(name: str, scale: float = 1.0) -> str:
    n = f"CAST(_{name}_n AS HUGEINT)"
    e = (f"(CASE WHEN _{name}_n > 0 THEN CAST({n} * _{name}_s2 - _{name}_s1 * _{name}_s1 AS DOUBLE)"
         f" / CAST({n} * {n} AS DOUBLE) END)")
    return e if scale == 1.0 else f"({e} / {float(scale) * float(scale)!r})"


def sql_std(name: str, scale: float = 1.0) -> str:
    n = f"CAST(_{name}_n AS HUGEINT)"
    e = (f"(CASE WHEN _{name}_n > 0 THEN sqrt(CAST({n} * _{name}_s2 - _{name}_s1 * _{name}_s1 AS DOUBLE)"
         f" / CAST({n} * {n} AS DOUBLE)) END)")
    return e if scale == 1.0 else f"({e} / {float(scale)!r})"
