"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, discard, shared_dir, small  # noqa: F401

# Executors get the functions of this folder with the task, whether or not they have the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: What counts as white space between tokens, alike in Spark and in the SQL twins.
TOKEN = "[^ \\t\\n\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """df with columns c0, c1, ..., where each name went, and the names.

    Operators work on the positional names, so an extra column may have any name. The first of
    equal names counts.
    """
    names = df.columns
    where: dict[str, str] = {}
    for i, name in enumerate(names):
        where.setdefault(name, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(names))]), where, names


def pick(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, whatever the others are called."""
    out, where, _ = flat(df)
    missing = [w for w in wanted if w not in where]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return out.select(*[F.col(where[w]).alias(w) for w in wanted])


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column, the first of that name, as DDL."""
    return next(f for f in df.schema if f.name == name).dataType.simpleString()


def bounded(docs: DataFrame, labels: DataFrame, label: str, sample: int, by_class: bool) -> DataFrame:
    """(doc_id, label, text) of labelled documents to train on, a text of a document once.

    At most `sample` documents, of each label if by_class: those of the least hashes of their ids,
    then of id and text, however many rows the ids have. Null ids and texts don't count, nor labels
    that are not 0 or 1; of several labels of a document the greatest does.
    """
    known = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    groups = (0, 1) if by_class else (None,)
    least = lambda df, *key: [df.where(F.lit(True) if g is None else F.col("label") == g).orderBy(F.xxhash64(*key), *key).limit(sample) for g in groups]
    ids = reduce(DataFrame.unionAll, least(known, "doc_id"))
    own = pick(docs, "doc_id", "text").where("text IS NOT NULL").withColumn("t", F.xxhash64("text")).join(F.broadcast(ids), "doc_id")
    keys = reduce(DataFrame.unionAll, least(own.select("doc_id", "t", "label").distinct(), "doc_id", "t")).drop("label")
    return own.join(F.broadcast(keys), ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.max("label").alias("label"), F.first("text").alias("text")).select("doc_id", "label", "text")


#: Rows of an Arrow batch where whole texts go to Python, in place of Spark's default of 10,000.
BATCH_ROWS = 2_000


def modest_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, as texts are long, unless the session asks for some number itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def n_tokens(text: Column) -> Column:
    """Number of runs without white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))
