"""How a column is read: the value rules every operator shares."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The moment formats tried in turn.
MOMENT_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
)
# Seconds per unit of a rate.
UNIT_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def names(value) -> list[str]:
    """A list option: "a,b" or ["a", "b"]."""
    if value is None:
        return []
    if isinstance(value, str):
        return [part.strip() for part in value.split(",") if part.strip()]
    return [str(part) for part in value]


def one_of(what: str, value: str, allowed: Iterable[str]) -> str:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"{what} {value!r} is not supported; use one of {allowed}")
    return value


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in the input; it has {sorted(df.columns)}")


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def col(df: DataFrame, column: str) -> Column:
    """A column by its exact name, or nulls where the table has none."""
    return F.col(f"`{column}`") if column in df.columns else F.lit(None).cast("string")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def half_up(c: Column, places: int) -> Column:
    """``round``, which goes by way of the number's text, by arithmetic wherever that gives the very same number."""
    scaled = c * F.lit(float(10**places))
    whole = F.floor(scaled + 0.5)
    # Close to a half, or where the last bit of a product counts, the text decides.
    clear = (scaled >= 0) & (scaled < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(clear, whole / F.lit(float(10**places))).otherwise(F.round(c, places))


def number(df: DataFrame, column: str) -> Column:
    """Lenient number: numbers as they are, text without thousands separators."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    dtype, c = kind(df, column), col(df, column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _finite_or_null(c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return _finite_or_null(F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))
    return F.lit(None).cast("double")


def float_view(df: DataFrame, column: str) -> Column:
    """Strict number: a plain cast; text that is no number, and booleans, are null."""
    if column not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(kind(df, column), T.BooleanType) or is_temporal(kind(df, column)):
        return F.lit(None).cast("double")
    return _finite_or_null(col(df, column).try_cast("double"))


def genuine(df: DataFrame, column: str) -> Column:
    """Only columns that hold numbers count as numbers; text never does."""
    if column in df.columns and is_numeric(kind(df, column)):
        return col(df, column).cast("double")
    return F.lit(None).cast("double")


def moment(df: DataFrame, column: str) -> Column:
    """Lenient moment as a session-zone timestamp."""
    if column not in df.columns:
        return F.lit(None).cast("timestamp")
    if is_temporal(kind(df, column)):
        return col(df, column).cast("timestamp")
    text = F.trim(col(df, column).cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in MOMENT_FORMATS])


def seconds(c: Column) -> Column:
    """Epoch seconds of a timestamp, with its fraction."""
    return F.unix_micros(c) / F.lit(1e6)


def axis(df: DataFrame, column: str) -> Column:
    """The x of a fit: seconds for moments, the number itself for numbers."""
    if is_numeric(kind(df, column)):
        return col(df, column).cast("double")
    return seconds(moment(df, column))


def text(df: DataFrame, column: str, null_as: str = "None") -> Column:
    return F.coalesce(col(df, column).cast("string"), F.lit(null_as))


def blank(df: DataFrame, column: str) -> Column:
    return col(df, column).isNull() | (F.trim(col(df, column).cast("string")) == "")


def printed(value) -> str:
    """A literal as the engine prints it, so that it meets a column cast to text."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "None"
    return str(value)


def short(value: float) -> str:
    return f"{value:g}"


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def ordering(order_by, *, descending: bool = False) -> list[Column]:
    """Sort columns with nulls last in both directions; "-x" sorts x down."""
    out = []
    for name in names(order_by):
        down = name.startswith("-") != descending
        c = F.col(f"`{name.lstrip('-')}`")
        out.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return out


def must_order(order_by) -> list[str]:
    order = names(order_by)
    if not order:
        raise ValueError("a DataFrame has no row order: name the order_by columns")
    return order


def to_places(c: Column, places: int) -> Column:
    return F.round(c, places)
