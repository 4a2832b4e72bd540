"""Numbers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: Stirling's series at x + 7, then the recurrence back."""
    z = x.cast("double") + 7
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    back = F.log(x.cast("double"))
    for k in range(1, 7):
        back = back + F.log(x + k)
    return series - back


def poisson_log_pmf(y: Column, mean: Column) -> Column:
    return y * F.log(mean) - mean - ln_gamma(y + 1)
