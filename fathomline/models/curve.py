"""Curve fits whose coefficients come from one aggregate over the table."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V

FAMILIES = ("linear", "polynomial", "exponential", "power", "logarithmic")
DEGREES = (2, 6)


def _pairs(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    V.need(df, x, y, *groups)
    return df.select(
        *[V.col(df, g) for g in groups], V.number(df, x).alias("_x"), V.number(df, y).alias("_y")
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _straight(family: str) -> tuple[Column, Column]:
    """The (x, y) in which the family is a straight line; null where it cannot be."""
    x, y = F.col("_x"), F.col("_y")
    ln_x, ln_y = F.when(x > 0, F.ln(x)), F.when(y > 0, F.ln(y))
    return {
        "linear": (x, y),
        "exponential": (x, ln_y),
        "power": (ln_x, ln_y),
        "logarithmic": (ln_x, y),
    }[family]


def _line(family: str) -> Column:
    """A struct (a, b, n) of the family's own coefficients."""
    u, v = _straight(family)
    slope, intercept = F.regr_slope(v, u), F.regr_intercept(v, u)
    a, b = {
        "linear": (slope, intercept),
        "exponential": (F.exp(intercept), slope),
        "power": (F.exp(intercept), slope),
        "logarithmic": (slope, intercept),
    }[family]
    return F.struct(a.alias("a"), b.alias("b"), F.regr_count(v, u).alias("n"))


def _value(family: str, fit: Column, x: Column) -> Column:
    a, b = fit["a"], fit["b"]
    return {
        "linear": a * x + b,
        "exponential": a * F.exp(b * x),
        "power": F.when(x > 0, a * F.pow(x, b)),
        "logarithmic": a * F.ln(F.greatest(x, F.lit(1e-12))) + b,
    }[family]


def polynomial_coefficients(df: DataFrame, *, x: str, y: str, degree: int) -> list[float]:
    """Highest power first. Only the sums of powers, a dozen numbers, reach the driver."""
    if not DEGREES[0] <= degree <= DEGREES[1]:
        raise ValueError(f"degree must lie between {DEGREES[0]} and {DEGREES[1]}")
    pairs = _pairs(df, x, y, [])
    centre = pairs.agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"), F.count("_x").alias("n"))
    c = centre.first()
    if c["n"] < degree + 1 or not c["s"]:
        raise ValueError(f"a fit of degree {degree} needs {degree + 1} rows with differing x")
    u = (F.col("_x") - F.lit(c["m"])) / F.lit(c["s"])
    powers = [F.sum(F.pow(u, F.lit(i))).alias(f"s{i}") for i in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(u, F.lit(i)) * F.col("_y")).alias(f"t{i}") for i in range(degree + 1)]
    row = pairs.agg(*powers, *mixed).first()
    normal = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    solved = np.linalg.solve(normal, np.array([row[f"t{i}"] for i in range(degree + 1)]))
    # From the centred and scaled variable back to x.
    scaled = np.poly1d([1.0 / c["s"], -c["m"] / c["s"]])
    total = np.poly1d([0.0])
    for i, k in enumerate(solved):
        total = total + k * scaled**i
    out = np.zeros(degree + 1)
    out[degree + 1 - len(total.coeffs):] = total.coeffs
    return [float(v) for v in out]


def fit_curve(
    df: DataFrame,
    *,
    x: str,
    y: str,
    family: str = "linear",
    degree: int = 2,
    group_by=None,
    predict_for=None,
) -> tuple[DataFrame, DataFrame]:
    """(x, y, fitted, residual) per usable row, and one row of metrics per group."""
    V.one_of("family", family, FAMILIES)
    groups = V.names(group_by)
    pairs = _pairs(df, x, y, groups)
    by = [F.col(f"`{g}`") for g in groups]
    if family == "polynomial":
        if groups:
            raise ValueError("a polynomial fit takes no groups")
        k = polynomial_coefficients(df, x=x, y=y, degree=degree)

        def value(c: Column) -> Column:
            out = F.lit(k[0])
            for part in k[1:]:
                out = out * c + F.lit(part)
            return out

        rows = pairs.withColumn("_f", value(F.col("_x")))
        coefficients = [F.lit(round(v, 6)).alias(f"c{degree - i}") for i, v in enumerate(k)]
    else:
        if groups:
            fits = pairs.groupBy(*by).agg(_line(family).alias("_fit"))
            fits = fits.withColumnsRenamed({g: f"_k{i}" for i, g in enumerate(groups)})
            same = V.every(
                [F.col(f"`{g}`").eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
            )
            rows = pairs.join(fits, same).drop(*[f"_k{i}" for i in range(len(groups))])
        else:
            rows = pairs.withColumn("_fit", pairs.agg(_line(family)).scalar())
        enough = F.when(
            F.col("_fit.n") >= 2, _value(family, F.col("_fit"), F.col("_x"))
        )
        rows = rows.withColumn("_f", enough)
        labels = {"linear": ("slope", "intercept")}.get(family, ("a", "b"))
        coefficients = [
            F.round(F.first(f"_fit.{c}"), 6).alias(name) for c, name in zip("ab", labels)
        ]
    rows = rows.withColumn("_r", F.col("_y") - F.col("_f"))
    residual = F.sum(F.col("_r") * F.col("_r"))
    spread = F.var_pop("_y") * F.count("_y")
    metrics = rows.groupBy(*by).agg(
        F.count("_y").alias("points"),
        F.when(spread > 0, F.round(1 - residual / spread, 6)).alias("r_squared"),
        F.round(F.sqrt(residual / F.count("_y")), 6).alias("rmse"),
        *coefficients,
    )
    if predict_for:
        if family == "polynomial":
            answers = [F.lit(round(float(np.polyval(k, float(v))), 6)) for v in predict_for]
        else:
            fit = F.struct(F.col(f"`{labels[0]}`").alias("a"), F.col(f"`{labels[1]}`").alias("b"))
            answers = [F.round(_value(family, fit, F.lit(float(v))), 6) for v in predict_for]
        metrics = metrics.withColumn("predictions", F.array(*answers))
    table = rows.select(
        *by, F.col("_x").alias(x), F.col("_y").alias(y),
        F.round("_f", 6).alias("fitted"), F.round("_r", 6).alias("residual"),
    )
    return table, metrics


def equation(family: str, coefficients: list[float]) -> str:
    def s(v: float) -> str:
        return f"{v:.4g}"

    if family == "polynomial":
        n = len(coefficients) - 1
        powers = [f"·x^{n - i}" if n - i > 1 else ("·x" if n - i == 1 else "") for i in range(n + 1)]
        return "y = " + " + ".join(s(c) + p for c, p in zip(coefficients, powers))
    a, b = coefficients
    return {
        "linear": f"y = {s(a)}·x + {s(b)}",
        "exponential": f"y = {s(a)}·e^({s(b)}·x)",
        "power": f"y = {s(a)}·x^{s(b)}",
        "logarithmic": f"y = {s(a)}·ln(x) + {s(b)}",
    }[family]
