"""Duplicates across micro-batches: bounded state for what arrives close together, a stored table of hashes for the rest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.streaming.ingest import _of_batches, file_stream

HASHES = "doc_id long, sha256 string"


def without_repeats(rows: DataFrame, key: str = "sha256", late: str = "1 hour", time: str | None = None) -> DataFrame:
    """Rows of a stream whose key hasn't come within ``late``; a key leaves the state when the watermark has passed it.

    Time is the arrival unless a column is named. By arrival no row is ever late, so none is lost; with a column of its own, rows
    later than ``late`` behind the newest are dropped by the engine.
    """
    timed = rows.withColumn("__time", F.current_timestamp() if time is None else F.col(time).cast("timestamp"))
    return timed.withWatermark("__time", late).dropDuplicatesWithinWatermark([key]).drop("__time")


def new_rows(batch: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of a batch whose key isn't known. The batch is the side that is hashed or broadcast; the known keys are only scanned."""
    seen = known.join(batch.select(key).distinct(), key, "left_semi").select(key).distinct()
    return batch.join(seen, key, "left_anti")


def deduped(spark: SparkSession, path: str, schema, shared: str, text_col: str = "text", late: str = "1 hour", time: str | None = None, files: int = 1, root: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Documents of the files of a path whose content came for the first time, and the progress of each micro-batch.

    Each batch writes the hashes it adds into a folder of its own, which a repetition overwrites; a batch knows those of earlier
    batches only. With the ``root`` of a run that failed it goes on from there.
    """
    root = root or f"{shared}/dedupe-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        fresh = new_rows(batch.select("doc_id", "sha256"), _of_batches(spark, f"{root}/known", HASHES, number))
        fresh.write.mode("overwrite").parquet(f"{root}/known/batch={number}")

    rows = file_stream(spark, path, schema, files).withColumn("sha256", F.sha2(text_col, 256))
    query = without_repeats(rows, "sha256", late, time).writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return _of_batches(spark, f"{root}/known", HASHES), [json.loads(p.json) for p in query.recentProgress]
