"""Source files of a workspace: discovery, exclusion, reading."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import matches_any

EXTENSIONS = ("rb", "rake", "rbs", "ru")


def language(uri) -> F.Column:
    return F.when(uri.endswith(".rbs"), "rbs").otherwise("ruby")


def language_of_id(name: str) -> str:
    """The language of an editor's language id."""
    if name not in ("ruby", "rbs"):
        raise ValueError(f"unsupported language {name!r}")
    return name


def list_files(spark: SparkSession, paths: list[str], exclude: list[str] = ()) -> tuple[DataFrame, list[dict]]:
    """((uri, source, language) of the files under the paths, errors for paths that aren't there).

    Folders are read recursively; a path that is a file is taken whatever its extension.
    """
    errors = [{"path": p, "message": "no such file or directory"} for p in paths if not Path(p).exists()]
    found = None
    for p in [x for x in paths if Path(x).exists()]:
        reader = spark.read.format("binaryFile")
        if Path(p).is_dir():
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
        own = reader.load(p).select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^", "file://").alias("uri"), F.col("content").cast("string").alias("source"), F.substring(F.regexp_replace("path", "^file:/*", "/"), len(str(Path(p).resolve())) + 2, 1 << 20).alias("inside"))
        if exclude:
            own = own.where(~matches_any(F.col("inside"), list(exclude)) & ~matches_any(F.regexp_replace("uri", "^file://", ""), list(exclude)))
        found = own if found is None else found.unionAll(own)
    if found is None:
        return spark.createDataFrame([], "uri string, source string, language string"), errors
    return found.dropDuplicates(["uri"]).select("uri", "source", language(F.col("uri")).alias("language")), errors


def workspace_paths(root: str) -> list[str]:
    """The children of a workspace's folder that are indexed: not hidden, no dependencies or logs."""
    skip = {"node_modules", "vendor", "tmp", "log", "coverage"}
    return sorted(str(p) for p in Path(root).iterdir() if not p.name.startswith(".") and p.name not in skip)
