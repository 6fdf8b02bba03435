"""Student's t without a statistics library, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of |t| with df >= 1 whole degrees of freedom; null where t is null. Closed form in the angle atan(|t|/sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    s, c = F.sin(angle), F.cos(angle)
    start = F.when(df % 2 == 0, F.lit(1.0)).otherwise(c)
    # Terms k = 2, 4, .. or 3, 5, .. up to df - 2: each is the one before times c^2 (k - 1) / k.
    first = F.when(df % 2 == 0, 2).otherwise(3)
    steps = F.when(df - 2 >= first, F.sequence(first.cast("int"), (df - 2).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(start.alias("term"), F.when(df > 1, start).otherwise(0.0).alias("sum"))
    total = F.aggregate(steps, zero, lambda a, k: F.struct((a["term"] * c * c * (k - 1) / k).alias("term"), (a["sum"] + a["term"] * c * c * (k - 1) / k).alias("sum")), lambda a: a["sum"])
    inside = F.when(df % 2 == 0, s * total).otherwise(2 / F.pi() * (angle + s * total))
    return F.when(inside.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def pooled_t_pvalue(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Two-sample test with pooled variance from counts, means and sample variances. No variance: 0 if the means differ, null if they don't."""
    df = n1 + n2 - 2
    ss = F.coalesce(v1, F.lit(0.0)) * (n1 - 1) + F.coalesce(v2, F.lit(0.0)) * (n2 - 1)
    t = (m1 - m2) / F.sqrt(ss / df * (1 / n1 + 1 / n2))
    return F.when(df < 1, None).when(ss == 0, F.when(m1 != m2, 0.0)).otherwise(t_pvalue(t, df))
