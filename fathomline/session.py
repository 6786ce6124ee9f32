"""Session settings the operators read, and the scratch space they write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows of one group that a single task may hold in a window or an exact quantile.
HOT_ROWS = ("fathomline.hotGroupRows", "5000000")
# Bytes of either side of a pair of blocks that one task compares.
BLOCK_BYTES = ("fathomline.blockBytes", str(64 << 20))


def setting(spark: SparkSession, entry: tuple[str, str]) -> int:
    return int(spark.conf.get(entry[0], entry[1]))


def build_session(app: str = "fathomline", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: one folder of this run under the cluster's checkpoint folder.

    Whoever owns the session may drop the run's folder when it ends. A session on one machine that names no
    checkpoint folder, as in tests, gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


@contextmanager
def null_on_failure(spark: SparkSession) -> Iterator[None]:
    """Expressions analysed inside give null where they would end the job: 1 / 0, a cast of bad text.

    Only how expressions are built is changed, and only here; whole numbers that overflow wrap around.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def settle(df: DataFrame) -> DataFrame:
    """Write a table to scratch and read it back.

    Used where later stages must see the very same rows in the very same
    partitions: a recomputed range shuffle may draw other boundaries.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_hot_group(df: DataFrame, group_by: list[str]) -> bool:
    """Whether one group holds more rows than one task should take, told by counting rows.

    A table with no more rows than that has none. Beyond, one map-side combined count over the key columns
    tells; operators made of several steps ask once.
    """
    limit = setting(df.sparkSession, HOT_ROWS)
    if not group_by:
        return df.count() > limit
    if limit > 0 and df.select(*group_by).count() <= limit:
        return False
    largest = df.groupBy(*group_by).count().agg(F.max("count")).first()[0]
    return (largest or 0) > limit
