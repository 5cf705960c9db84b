"""Cutting lineage in the folder that all executors share, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a table may have to be broadcast, as its rows and the widths of its columns say.
BROADCAST_BYTES = 16_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    context = spark.sparkContext
    scala = context._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not scala.getCheckpointDir().isDefined():
        if found is None and not scala.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or Path(tempfile.mkdtemp(prefix="weft-")).as_uri())
    return found or scala.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that later jobs neither recompute it nor need its executors.

    Shuffle files that only served to make it are removed at once. The estimated size of what it was
    made from is forgotten: estimates of joins are products, and over the rounds of a loop they would
    become numbers of millions of digits.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    rows = kept._jdf.logicalPlan().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def discard(*tables: DataFrame) -> None:
    """Remove what cut() wrote for these tables, which nothing may read any more."""
    for df in tables:
        spark = df.sparkSession
        plan = df._jdf.logicalPlan()
        found = plan.rdd().getCheckpointFile() if plan.nodeName().startswith(("LogicalRDD", "Scan")) else None
        if found is not None and found.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(df: DataFrame) -> int:
    """Bytes of a row in a hash table, about; columns without a fixed width count as 40."""

    def of(kind) -> int:
        name = kind.typeName()
        if name == "struct":
            return sum(of(f.dataType) for f in kind.fields)
        return 8 if name in ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz") else 40

    return 96 + sum(of(f.dataType) for f in df.schema.fields)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a cut table of ids, to be broadcast if its rows make at most so many bytes; beyond, the same join shuffles."""
    rows = most // width(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
