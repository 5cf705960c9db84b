"""The facts of files of any language, read in mapInArrow tasks, each file on its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rbs import SignatureReader
from .ruby import FACTS, Reader

#: Facts of a batch, about; a file's facts stay together.
ROWS = 2_000


def read_file(uri: str, source: str) -> list[dict]:
    """The facts of a file: a signature file by its ending, anything else as source."""
    kind = SignatureReader if uri and uri.endswith(".rbs") else Reader
    return kind(uri, source).read()


def facts(sources: DataFrame) -> DataFrame:
    """FACTS of sources(uri, source), source files and signature files alike; a null source is an empty file.

    Files are spread by their URIs over as many tasks as an exchange has: they take far longer to read than
    their size tells, by which adaptive execution would put them together.
    """
    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for uri, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += read_file(uri, source or "")
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    pair = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
    text, number, flag = pa.string(), pa.int32(), pa.bool_()
    kinds = pa.schema([
        ("uri", text), ("id", pa.int64()), ("fact", text), ("kind", text), ("path", text), ("start", number), ("end", number), ("line", number), ("scope", pa.list_(pa.int64())),
        ("singleton", flag), ("visibility", text), ("deprecated", flag), ("promotable", flag), ("old", text), ("target", text), ("superclass", text),
        ("mixins", pair("kind", "target")), ("params", pair("kind", "name")), ("comments", pa.list_(text)), ("receiver", text), ("lexical", pa.list_(text)),
    ])
    return sources.select("uri", F.col("source").cast("string")).repartition(tasks, "uri").mapInArrow(run, FACTS)
