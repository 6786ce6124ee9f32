"""Columns of the caller carried through Arrow functions under names that clash with nothing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType


def schema_of(df: DataFrame, columns: tuple[str, ...] | list[str], more: str) -> StructType:
    """Fields of the given columns, nullable, followed by those of a DDL text."""
    return StructType([StructField(c, df.schema[c].dataType, True) for c in columns] + StructType.fromDDL(more).fields)


def disguised(df: DataFrame, *more: str) -> DataFrame:
    """All columns as own_0, own_1 ..., and the named ones once more under their names."""
    return df.select(*(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(df.columns)), *more)


def undisguised(names: list[str]) -> list[Column]:
    return [F.col(f"own_{k}").alias(c) for k, c in enumerate(names)]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch(columns: list, ddl: str) -> pa.RecordBatch:
    """A batch with the names and types of a DDL text of plain types."""
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
