"""Covariate adjustment: ordinary least squares for many responses at once, from grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _solve(a: list[list[Column]], y: list[Column]) -> list[Column]:
    """Cramer's rule; null where the covariates are collinear."""

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        out = None
        for k, x in enumerate(m[0]):
            part = x * det([r[:k] + r[k + 1 :] for r in m[1:]])
            out = part if out is None else (out - part if k % 2 else out + part)
        return out

    whole = F.nullif(det(a), F.lit(0.0))
    return [det([[y[r] if c == k else v for c, v in enumerate(row)] for r, row in enumerate(a)]) / whole for k in range(len(a))]


def residuals(values: DataFrame, keys: Sequence[str], covariates: Sequence[str], keep_mean: bool = False, value: str = "value") -> DataFrame:
    """values with value replaced by its residual on an intercept and the covariates, within each group of keys.

    keep_mean adds the group's mean back. One grouped pass over centred products, then one join; rows with a null
    covariate or value go."""
    rows = values.dropna(subset=[value, *covariates])
    x, y = [F.col(c).cast("double") for c in covariates], F.col(value).cast("double")
    sums = {f"x{i}{j}": F.covar_pop(x[i], x[j]) for i in range(len(x)) for j in range(i, len(x))} | {f"y{i}": F.covar_pop(x[i], y) for i in range(len(x))}
    means = {f"m{i}": F.avg(c) for i, c in enumerate(x)} | {"my": F.avg(y)}
    fitted = rows.groupBy(*keys).agg(*(c.alias(f"__{n}") for n, c in (sums | means).items()))
    a = [[F.col(f"__x{min(i, j)}{max(i, j)}") for j in range(len(x))] for i in range(len(x))]
    slopes = _solve(a, [F.col(f"__y{i}") for i in range(len(x))])
    fitted = fitted.select(*keys, *(F.coalesce(b, F.lit(0.0)).alias(f"__b{i}") for i, b in enumerate(slopes)), *(f"__m{i}" for i in range(len(x))), "__my")
    out = y - F.col("__my")
    for i, c in enumerate(x):
        out = out - F.col(f"__b{i}") * (c - F.col(f"__m{i}"))
    if keep_mean:
        out = out + F.col("__my")
    return rows.join(fitted, list(keys)).select(*[F.col(c) if c != value else out.alias(value) for c in values.columns])


def centred(values: DataFrame, column: str) -> DataFrame:
    """values with a column less its mean over all rows."""
    mean = values.agg(F.avg(column).alias("__mean"))
    return values.crossJoin(F.broadcast(mean)).withColumn(column, F.col(column) - F.col("__mean")).drop("__mean")
