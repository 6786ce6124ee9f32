"""Named datasets whose every version is a Parquet folder that never changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from fathomline.functions import values as V
from fathomline.sources.readers import describe_schema

ENTRY = (
    "dataset string, version bigint, rows bigint, columns bigint, schema string, lineage string, "
    "created_at timestamp"
)
PREVIEW_ROWS = 100
LISTING = "_versions"


class Datasets:
    """Versions under one root folder: <root>/<name>/v=<n>, listed in <root>/_versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # An empty listing to start from; one that exists is left alone.
        spark.createDataFrame([], ENTRY).write.mode("ignore").parquet(self._listing())

    def _listing(self) -> str:
        return f"{self.root}/{LISTING}"

    def versions(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self._listing())

    def current(self, name: str) -> int:
        return self.versions().where(F.col("dataset") == name).agg(F.max("version")).first()[0] or 0

    def _last_folder(self, name: str) -> int:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(folder) if files.exists(folder) else []
        names = [f.getPath().getName() for f in found]
        return max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), default=0)

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def write(self, df: DataFrame, name: str, *, lineage: dict | None = None, partition_by=None) -> int:
        """The next version. Rows are counted while they are written.

        A version folder that exists already makes the write fail, so two writers
        cannot make the same one. A folder whose writer died before listing it is
        passed over.
        """
        if name == LISTING:
            raise ValueError(f"{LISTING!r} is the name of the listing")
        version = max(self.current(name), self._last_folder(name)) + 1
        seen = Observation(f"{name}-v{version}")
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        parts = V.names(partition_by)
        (writer.partitionBy(*parts) if parts else writer).parquet(self.path(name, version))
        entry = self.spark.range(1).select(
            F.lit(name).alias("dataset"), F.lit(version).cast("bigint").alias("version"),
            F.lit(seen.get["rows"]).cast("bigint").alias("rows"),
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.lit(json.dumps(describe_schema(df))).alias("schema"),
            F.lit(json.dumps(lineage or {})).alias("lineage"),
            F.current_timestamp().alias("created_at"),
        )
        entry.coalesce(1).write.mode("append").parquet(self._listing())
        return version

    def read(self, name: str, *, version: int | None = None, columns=None) -> DataFrame:
        at = version or self.current(name)
        if not at:
            raise ValueError(f"there is no dataset {name!r}")
        df = self.spark.read.parquet(self.path(name, at))
        wanted = V.names(columns)
        return df.select(*[V.col(df, c) for c in wanted]) if wanted else df

    def refresh(self, name: str, read: Callable[[SparkSession], DataFrame]) -> int:
        """Read the source again into a further version; earlier ones stay."""
        return self.write(read(self.spark), name, lineage={"refreshed_from": self.current(name)})

    def preview(self, name: str, *, rows: int = PREVIEW_ROWS) -> tuple[DataFrame, list[dict], int]:
        df = self.read(name)
        return df.limit(rows), describe_schema(df), self.row_count(name)

    def row_count(self, name: str, *, version: int | None = None) -> int:
        """From the listing, which no scan is needed for."""
        at = version or self.current(name)
        row = self.versions().where((F.col("dataset") == name) & (F.col("version") == at)).first()
        if row is None:
            raise ValueError(f"there is no version {at} of {name!r}")
        return row["rows"]
