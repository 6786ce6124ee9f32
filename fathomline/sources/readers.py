"""Tables in: files, databases, inline rows; nested and mixed columns; contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fathomline.functions import values as V

# Suffixes and their readers, and the row limit of a database read.
SUFFIXES = {
    "csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson",
    "parquet": "parquet",
}


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(int(limit))


def read_csv(
    spark: SparkSession, path: str, *, delimiter: str = ",", encoding: str = "utf-8",
    limit: int | None = None, schema: T.StructType | str | None = None,
) -> DataFrame:
    """Header and types are read from the file; give a schema to save that pass."""
    reader = spark.read.options(header=True, sep=delimiter, encoding=encoding, escape='"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return _limited(reader.csv(path), limit)


def read_json(spark: SparkSession, path: str, *, records_path: str | None = None,
              limit: int | None = None) -> DataFrame:
    """A JSON document: its records lie under a dotted path; one object is one record."""
    df = spark.read.json(path, multiLine=True)
    for step in [p for p in (records_path or "").split(".") if p]:
        if step not in df.columns:
            raise ValueError(f"nothing at {step!r} of {records_path!r}; there is {df.columns}")
        dtype = df.schema[step].dataType
        if isinstance(dtype, T.ArrayType):
            df = df.select(F.explode(F.col(f"`{step}`")).alias("_r"))
            dtype = dtype.elementType
        else:
            df = df.select(F.col(f"`{step}`").alias("_r"))
        if not isinstance(dtype, T.StructType):
            raise ValueError(f"{records_path!r} leads to {dtype.simpleString()}, not to objects")
        df = df.where(F.col("_r").isNotNull()).select("_r.*")
    return _limited(df, limit)


def read_ndjson(spark: SparkSession, path: str, *, limit: int | None = None,
                schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return _limited(reader.json(path), limit)


def read_parquet(spark: SparkSession, path: str, *, columns=None, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    wanted = V.names(columns)
    if wanted:
        V.need(df, *wanted)
        df = df.select(*[V.col(df, c) for c in wanted])
    return _limited(df, limit)


def database_options(
    url: str, *, table: str | None = None, query: str | None = None, partition: dict | None = None,
    fetch_size: int = 10_000, properties: dict | None = None,
) -> dict[str, str]:
    """JDBC options; `partition` is {column, lower, upper, parts} for a parallel read."""
    if bool(table) == bool(query):
        raise ValueError("name one table or one query")
    out = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if partition:
        # A partitioned read takes a table, so a query becomes a derived one.
        out["dbtable"] = table or f"({query}) q"
        out |= {
            "partitionColumn": partition["column"], "lowerBound": str(partition["lower"]),
            "upperBound": str(partition["upper"]), "numPartitions": str(partition["parts"]),
        }
    else:
        out |= {"dbtable": table} if table else {"query": query}
    return out


def read_database(spark: SparkSession, url: str, *, limit: int | None = None, **options) -> DataFrame:
    return _limited(spark.read.format("jdbc").options(**database_options(url, **options)).load(), limit)


def read_uri(spark: SparkSession, uri: str, **options) -> DataFrame:
    """Any file system Spark knows; the suffix picks the reader."""
    suffix = uri.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no reader for {uri!r}; known suffixes are {sorted(SUFFIXES)}")
    kind = SUFFIXES[suffix]
    if kind == "tsv":
        return read_csv(spark, uri, **{"delimiter": "\t", **options})
    return {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "parquet": read_parquet}[kind](
        spark, uri, **options
    )


def _cell(value):
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list, tuple)) else value


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return "string"
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "bigint"
    if kinds <= {int, float}:
        return "double"
    return "string"


def inline_rows(spark: SparkSession, rows: list, *, schema: str | T.StructType | None = None) -> DataFrame:
    """Objects the caller brings; columns in first-seen order, mixed ones as text."""
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            raise ValueError(f"row {i} is no object but {type(row).__name__}")
    columns = list(dict.fromkeys(c for r in rows for c in r))
    cells = {c: [_cell(r.get(c)) for r in rows] for c in columns}
    if schema is None:
        kinds = {c: _kind(v) for c, v in cells.items()}
        for c, kind in kinds.items():
            if kind == "string":
                cells[c] = [v if v is None or isinstance(v, str) else V.printed(v) for v in cells[c]]
            elif kind == "double":
                cells[c] = [None if v is None else float(v) for v in cells[c]]
        schema = T.StructType([
            T.StructField(c, {"boolean": T.BooleanType(), "bigint": T.LongType(),
                              "double": T.DoubleType(), "string": T.StringType()}[k])
            for c, k in kinds.items()
        ])
    return spark.createDataFrame([tuple(cells[c][i] for c in columns) for i in range(len(rows))], schema)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs, lists and maps become JSON text."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(V.col(df, c)) for c in nested}) if nested else df


def parse_nested(df: DataFrame, *, schemas: dict[str, str]) -> DataFrame:
    V.need(df, *schemas)
    return df.withColumns({c: F.from_json(V.col(df, c), s) for c, s in schemas.items()})


def promote_text(df: DataFrame, *, columns=None) -> DataFrame:
    """Text columns whose every value reads as one type become that type.

    One aggregate over the table decides; a column of mixed types stays text.
    """
    wanted = V.names(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    order = ("bigint", "double", "boolean", "timestamp")
    if not wanted:
        return df
    fits = []
    for i, c in enumerate(wanted):
        text = V.col(df, c)
        fits += [
            F.count_if(text.isNotNull() & text.try_cast(k).isNull()).alias(f"{k}{i}") for k in order
        ] + [F.count(text).alias(f"n{i}")]
    row = df.agg(*fits).first()
    out = {}
    for i, c in enumerate(wanted):
        kind = next((k for k in order if row[f"n{i}"] and row[f"{k}{i}"] == 0), None)
        if kind:
            out[c] = V.col(df, c).try_cast(kind)
    return df.withColumns(out) if out else df


def field_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if V.is_numeric(dtype):
        return "float"
    if V.is_temporal(dtype):
        return "timestamp"
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "json" if isinstance(dtype, (T.StructType, T.MapType)) else "any"


def describe_schema(df: DataFrame) -> list[dict]:
    return [
        {"name": f.name, "type": field_type(f.dataType), "nullable": f.nullable} for f in df.schema
    ]


def check_contract(df: DataFrame, contract: list[dict]) -> dict[str, list[str]]:
    """A required column missing is an error, another type a warning; numbers are alike."""
    found = {d["name"]: d["type"] for d in describe_schema(df)}
    errors, warnings = [], []
    for spec in contract:
        name, wanted = spec["name"], spec.get("type", "any")
        if name not in found:
            if spec.get("required", True):
                errors.append(f"column {name!r} is missing")
            continue
        have = found[name]
        alike = have == wanted or "any" in (have, wanted) or {have, wanted} == {"integer", "float"}
        if not alike:
            warnings.append(f"column {name!r} is {have}, wanted {wanted}")
    return {"errors": errors, "warnings": warnings}


def sequence(df: DataFrame, order_by, output: str = "_seq") -> DataFrame:
    """A row number in a stated order, for operators that follow arrival order."""
    from fathomline.operators.ordered import position

    return position(df, output, order_by=order_by)
