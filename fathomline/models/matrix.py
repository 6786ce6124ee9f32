"""Likelihood against consequence, read off a grid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.models.scorecard import shown


@dataclass
class Axis:
    column: str
    levels: list[str]
    # One boundary fewer than levels: at or below the i-th is the i-th level.
    bands: list[float] = field(default_factory=list)
    default: str | None = None

    def check(self, name: str) -> None:
        if len(self.levels) < 2:
            raise ValueError(f"{name} needs at least two levels")
        if self.bands and len(self.bands) != len(self.levels) - 1:
            raise ValueError(f"{name} needs {len(self.levels) - 1} bands, not {len(self.bands)}")
        if list(self.bands) != sorted(self.bands):
            raise ValueError(f"{name} bands must rise")
        if self.default is not None and self.default not in self.levels:
            raise ValueError(f"{name} default {self.default!r} is not one of {self.levels}")

    def read(self, df: DataFrame) -> tuple[Column, Column]:
        """(level, how it was read)."""
        fallback = F.lit(self.default).cast("string")
        if self.bands:
            v = V.number(df, self.column)
            level, why = F.when(v.isNull(), fallback), F.when(
                v.isNull(), F.lit(f"{self.column} has no reading")
            )
            named = F.concat(F.lit(f"{self.column} = "), shown(v))
            for edge, name in zip(self.bands, self.levels):
                level = level.when(v <= F.lit(float(edge)), F.lit(name))
                why = why.when(
                    v <= F.lit(float(edge)), F.concat(named, F.lit(f" ≤ {V.short(edge)}"))
                )
            return level.otherwise(F.lit(self.levels[-1])), why.otherwise(
                F.concat(named, F.lit(" above every band"))
            )
        label = F.trim(V.col(df, self.column).cast("string"))
        unknown = F.raise_error(
            F.concat(F.lit(f"{self.column}: no such level as "), label)
        ).cast("string")
        level = (
            F.when(V.blank(df, self.column), fallback)
            .when(label.isin(*self.levels), label)
            .otherwise(unknown)
        )
        why = F.when(V.blank(df, self.column), F.lit(f"{self.column} is empty")).otherwise(
            F.concat(F.lit(f"{self.column} = "), label)
        )
        return level, why


def risk_matrix(
    df: DataFrame,
    *,
    likelihood: Axis | dict,
    consequence: Axis | dict,
    grid: list[list[str]],
    severity_order: list[str] | None = None,
    output: str = "risk_level",
) -> DataFrame:
    rows = likelihood if isinstance(likelihood, Axis) else Axis(**likelihood)
    cols = consequence if isinstance(consequence, Axis) else Axis(**consequence)
    rows.check("likelihood")
    cols.check("consequence")
    if len(grid) != len(rows.levels) or any(len(r) != len(cols.levels) for r in grid):
        raise ValueError(f"the grid must be {len(rows.levels)} by {len(cols.levels)} cells")
    cells = list(dict.fromkeys(c for r in grid for c in r))
    order = list(severity_order or cells)
    lost = sorted(set(cells) - set(order))
    if lost:
        raise ValueError(f"severity_order leaves out {lost}")
    row, why_row = rows.read(df)
    col, why_col = cols.read(df)
    pairs = [
        F.lit(x)
        for i, r in enumerate(rows.levels)
        for j, c in enumerate(cols.levels)
        for x in (f"{r}|{c}", grid[i][j])
    ]
    read = df.withColumns({"_row": row, "_col": col, "_why": F.concat_ws("; ", why_row, why_col)})
    level = F.create_map(*pairs)[F.concat(F.col("_row"), F.lit("|"), F.col("_col"))]
    read = read.withColumn(output, level)
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(f"`{output}`"))
    return read.withColumns(
        {
            f"{output}_likelihood": F.col("_row"),
            f"{output}_consequence": F.col("_col"),
            f"{output}_rank": rank,
            f"{output}_basis": F.col("_why"),
        }
    ).drop("_row", "_col", "_why")
