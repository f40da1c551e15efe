"""Tables published in whole versions: a reader meets a complete version or none, never half of one.

A version is a folder of Parquet tables beneath a path. Its last table is the mark ``complete``, which the writer's
own success file makes visible at once; versions are never changed, so readers of an older one are not disturbed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MARK = "complete"
_TRIES = 100


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none where it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def _folder(path: str, version: int) -> str:
    return f"{path}/v{version:08d}"


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """The numbers of the versions beneath ``path``, in order; with ``complete`` only of whole ones."""
    names = [n for n in listed(spark, path) if n.startswith("v") and n[1:].isdigit()]
    found = sorted(int(n[1:]) for n in names)
    if not complete:
        return found
    return [v for v in found if "_SUCCESS" in listed(spark, f"{_folder(path, v)}/{_MARK}")]


def publish(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> int:
    """Write ``parts`` as the next version and return its number.

    Two writers never share a number: the first table of a version is a claim that only one can make.
    """
    for _ in range(_TRIES):
        version = max(versions(spark, path, complete=False), default=0) + 1
        folder = _folder(path, version)
        try:
            spark.range(1).write.mode("errorifexists").parquet(f"{folder}/claim")
        except AnalysisException as taken:
            if "PATH_ALREADY_EXISTS" not in str(taken):
                raise
            continue
        for name, part in parts.items():
            part.write.parquet(f"{folder}/{name}")
        spark.createDataFrame([(sorted(parts),)], "parts array<string>").coalesce(1).write.parquet(f"{folder}/{_MARK}")
        return version
    raise RuntimeError(f"no free version beneath {path}")


def published(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """The places of a version's tables by name: the newest whole one, or the one that is asked for."""
    whole = versions(spark, path)
    if not whole or (version is not None and version not in whole):
        raise FileNotFoundError(f"no whole version {'' if version is None else version} beneath {path}")
    folder = _folder(path, whole[-1] if version is None else version)
    names = spark.read.parquet(f"{folder}/{_MARK}").first()["parts"]
    return {name: f"{folder}/{name}" for name in names}
