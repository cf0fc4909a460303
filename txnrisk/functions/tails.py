"""Tail probabilities for the handful of aggregated rows that carry a test statistic.

Both are tiny pandas UDFs over already aggregated rows. They are built inside functions so that
they travel to the executors by value and need nothing installed there.
"""

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def chi_square_tail():
    """Upper tail of chi-square for whole degrees of freedom, as a plain function."""

    def tail(x: float, dof: int) -> float:
        import math

        if x <= 0 or dof <= 0:
            return 1.0
        half = x / 2.0
        odd = dof % 2
        total = math.erfc(math.sqrt(half)) if odd else 0.0
        term = math.exp(-half) * (2.0 * math.sqrt(half / math.pi) if odd else 1.0)
        shift = 1.5 if odd else 1.0
        for step in range(dof // 2):
            total += term
            term *= half / (shift + step)
        return min(1.0, total)

    return tail


def chi_square_p(statistic: Column, dof: Column) -> Column:
    tail = chi_square_tail()

    @F.pandas_udf(T.DoubleType())
    def batch(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(a) else tail(float(a), int(b)) for a, b in zip(x, k)],
            dtype="float64",
        )

    return batch(statistic, dof)


def two_sided_normal_p(z: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def batch(values: pd.Series) -> pd.Series:
        import math

        return pd.Series(
            [None if pd.isna(v) else min(1.0, math.erfc(v / math.sqrt(2.0))) for v in values],
            dtype="float64",
        )

    return batch(z)
