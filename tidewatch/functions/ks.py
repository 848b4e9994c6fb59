"""Two-sample Kolmogorov-Smirnov p-value as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TERMS = 99
_SMALL = 1e-6


def ks_p_value(statistic: Column, n_x: Column, n_y: Column) -> Column:
    """Asymptotic p-value, series stopped after its first term below 1e-6."""
    nx, ny = n_x.cast("double"), n_y.cast("double")
    en = F.sqrt(nx * ny / (nx + ny))
    lam = (en + 0.12 + F.lit(0.11) / en) * statistic

    def add_term(state: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        term = sign * F.exp(lam * lam * -2.0 * k * k)
        return F.when(state["stopped"], state).otherwise(
            F.struct(
                (state["total"] + term).alias("total"),
                (F.abs(term) < _SMALL).alias("stopped"),
            )
        )

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("stopped")),
        add_term,
        lambda state: state["total"],
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
