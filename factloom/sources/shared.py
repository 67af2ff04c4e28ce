"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary folder.

    On a cluster it must be set: a folder of one machine is lost with it, and the others don't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="factloom-"))
        named = _own[0]
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once into the shared folder and read back, for what several branches use."""
    path = f"{shared_dir(df.sparkSession)}/factloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, for clusters on which it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._factloom_shipped = True


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, to be broadcast in joins if its counted number is at most ``most``."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
