"""Statistics as column expressions, so that they run over any number of groups at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE = 1e-9
Z95 = 1.959963984540054


def mean(x: Column) -> Column:
    """Mean to four places; 0 over nothing. Halves go up, whatever order the sum was taken in."""
    return F.round(F.coalesce(F.avg(x.cast("double")), F.lit(0.0)) + TIE, 4)


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b to four places, a stated value where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(a / b, 4))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, four places, within [0, 1]; 0 and 0 over nothing."""
    p, z2 = k / n, F.lit(Z95 * Z95)
    centre, scale = p + z2 / (2 * n), 1 + z2 / n
    spread = F.lit(Z95) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    low, high = F.round(F.greatest(F.lit(0.0), (centre - spread) / scale), 4), F.round(F.least(F.lit(1.0), (centre + spread) / scale), 4)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


#: The rational approximation of erfc by Abramowitz and Stegun, 7.1.26 (error under 1.5e-7).
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """For x >= 0."""
    t = 1 / (1 + F.lit(ERFC[0]) * x)
    poly = t * (F.lit(ERFC[1]) + t * (F.lit(ERFC[2]) + t * (F.lit(ERFC[3]) + t * (F.lit(ERFC[4]) + t * F.lit(ERFC[5])))))
    return poly * F.exp(-x * x)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Statistic with continuity correction and p-value from the discordant counts; p is 1 without any."""
    n = b + c
    chi = F.when(n == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), 2) / n)
    return F.round(chi, 6), F.when(n == 0, 1.0).otherwise(F.round(erfc(F.sqrt(chi / 2)), 6))


def draw(*parts: Column) -> Column:
    """A number in [0, 2^32) that depends on nothing but the parts: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
