"""A change feed applied to a workspace, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import Workspace, latest

CHANGES = "uri string, source string, deleted boolean, seq long"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The feed of JSON files in a folder."""
    return spark.readStream.schema(CHANGES).json(path)


def follow(feed: DataFrame, workspace: Workspace, checkpoint: str, each: Callable[[Workspace, int], None], once: bool = False) -> StreamingQuery:
    """Apply the feed's batches in turn; each(workspace, batch) is called after every one.

    Within a batch the last change of a URI counts. A batch that comes again after a failure
    changes nothing: contents with the hash they have already are passed over.
    """
    state = {"workspace": workspace}

    def apply(batch: DataFrame, number: int) -> None:
        changes = latest(batch).select("uri", "source", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        state["workspace"] = state["workspace"].apply(changes)
        each(state["workspace"], number)

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
