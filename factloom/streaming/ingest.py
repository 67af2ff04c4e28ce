"""Structured Streaming: incremental ingest, duplicates across batches, event counters, job states, append logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.conflicts import current_status


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows; with a stream, events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n")


def job_states(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Latest kind and time of each reference with the number of its events; as a stream, in update or complete mode."""
    last = F.max(F.struct("ts", tie, "kind")).alias("last")
    return events.groupBy("ref_id").agg(last, F.count("*").alias("n")).select("ref_id", F.col("last.kind").alias("kind"), F.col("last.ts").alias("ts"), "n")


def answer_rates(events: DataFrame) -> DataFrame:
    """Shares of answered questions, resolved conflicts and approved reports, and the mean of those observed."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = events.agg(
        F.try_divide(n("answer_grounded"), n("answer_grounded", "answer_abstained")).alias("answer_rate"),
        F.try_divide(n("conflict_resolved"), n("conflict_resolved", "conflict_acknowledged")).alias("conflict_rate"),
        F.try_divide(n("report_approved"), n("report_approved", "report_rejected")).alias("approval_rate"),
    )
    given = F.filter(F.array("answer_rate", "conflict_rate", "approval_rate"), lambda x: x.isNotNull())
    return out.withColumn("mean_rate", F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given)).select(*(F.round(c, 6).alias(c) for c in ("answer_rate", "conflict_rate", "approval_rate", "mean_rate")))


def file_stream(spark: SparkSession, path: str, schema, files: int) -> DataFrame:
    """Stream of the Parquet files of a folder, or of a path that is one file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if all(f.rstrip("/").rsplit("/", 1)[-1] == name for f in spark.read.parquet(path).inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rsplit("/", 1)[0])
    return reader.parquet(path)


def replay(spark: SparkSession, path: str, schema, build, mode: str, shared: str) -> DataFrame:
    """Run ``build`` over the files of a path as a stream in append or complete mode until all are read, and return the final table.

    The sink is a table of Parquet files in the shared folder, replaced with each micro-batch (complete or update state is small
    next to the input), so the result is there on every executor.
    """
    if mode not in ("append", "complete"):
        raise ValueError("rows that later batches replace need a key: use status_log")
    out = f"{shared}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream = build(file_stream(spark, path, schema, 8))
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _of_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows that batches (those numbered below ``before``) have written under a path; none where there is nothing yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def ingest_batch(batch: DataFrame, number: int, root: str, build) -> None:
    """One micro-batch of documents: rows without text go to a dead-letter table, known or repeated content is left out, ``build`` makes the derived rows.

    Each table has a folder for each batch, which is overwritten, so a batch that is run again leaves what one run would have left:
    only content of earlier batches is known to it. Hashes are written last, when the derived rows are there.
    """
    spark = batch.sparkSession
    hashed = batch.where("text <> ''").withColumn("sha256", F.sha2("text", 256))
    hashed = hashed.withColumn("first", F.row_number().over(Window.partitionBy("sha256").orderBy("doc_id"))).where("first = 1").drop("first")
    fresh = hashed.join(_of_batches(spark, f"{root}/known", KNOWN, number).select("sha256"), "sha256", "left_anti")
    for name, rows in (("dead", batch.where("text is null or text = ''").withColumn("error", F.lit("no text"))), ("derived", build(fresh)), ("known", fresh.select("doc_id", "sha256"))):
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")


KNOWN = "doc_id long, sha256 string"


def ingest(spark: SparkSession, path: str, schema, shared: str, build, root: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stream all files of a path through :func:`ingest_batch`; returns known documents, dead letters and derived rows.

    With the ``root`` of a run that failed it goes on from there.
    """
    root = root or f"{shared}/ingest-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            ingest_batch(batch, number, root, build)
        finally:
            batch.unpersist()

    rows = file_stream(spark, path, schema, 4)
    rows.writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.parquet(f"{root}/{name}").drop("batch") for name in ("known", "dead", "derived"))


def status_log(spark: SparkSession, path: str, schema, shared: str, build, key: str, time: str, columns: list[str], tie: str, root: str | None = None) -> DataFrame:
    """The current row of each key of an append-only log that arrives as files; ``build`` selects the log from the file's rows.

    Every batch writes the state after it, made from the state of the last batch before it and its own rows, so a batch can be run again.
    """
    root = root or f"{shared}/status-{uuid.uuid4().hex}"

    def state(number: int | None) -> DataFrame | None:
        try:
            every = spark.read.parquet(f"{root}/state")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        every = every if number is None else every.where(F.col("batch") < number)
        last = every.agg(F.max("batch")).first()[0]
        return None if last is None else every.where(F.col("batch") == last).drop("batch")

    def write(batch: DataFrame, number: int) -> None:
        rows, before = build(batch).select(key, time, tie, *columns), state(number)
        rows = rows if before is None else before.unionByName(rows)
        w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
        now = current_status(rows, key, time, columns, tie).join(rows.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, tie), key)
        now.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    file_stream(spark, path, schema, 4).writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return state(None).select(key, time, *columns)


def committed(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of a table of batches whose manifest is there; a batch that failed half-way isn't seen."""
    done = spark.read.schema("batch long, name string, n long").parquet(f"{root}/manifest").where(F.col("name") == name).select("batch")
    rows = spark.read.parquet(f"{root}/{name}").join(F.broadcast(done), "batch", "left_semi")  # a row for each batch
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def ingest_tables(spark: SparkSession, path: str, schema, shared: str, build, root: str | None = None, files: int = 4) -> str:
    """Stream the files of a path into several derived tables; returns the root under which :func:`committed` reads them.

    ``build`` makes the tables (name to rows) of the new documents of a batch. A batch is one transaction: its tables ``known``,
    ``dead`` (documents without text) and those of ``build`` go into folders of the batch, which a repetition overwrites, and its
    manifest, with the rows of each table, is written last. Content known from committed batches, or repeated in the batch, is left out.
    """
    root = root or f"{shared}/ingest-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            hashed = batch.where("text <> ''").withColumn("sha256", F.sha2("text", 256))
            first = F.row_number().over(Window.partitionBy("sha256").orderBy("doc_id"))
            fresh = hashed.withColumn("__r", first).where("__r = 1").drop("__r")
            if number:
                seen = committed(spark, root, "known", number).join(fresh.select("sha256"), "sha256", "left_semi").select("sha256")
                fresh = fresh.join(seen, "sha256", "left_anti")
            dead = batch.where("text is null or text = ''").select("doc_id", F.lit("no text").alias("error"))
            tables = {"known": fresh.select("doc_id", "sha256"), "dead": dead} | build(fresh)
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            counts = [(name, spark.read.schema(rows.schema).parquet(f"{root}/{name}/batch={number}").count()) for name, rows in tables.items()]
            spark.createDataFrame(counts, "name string, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={number}")
        finally:
            batch.unpersist()

    rows = file_stream(spark, path, schema, files)
    rows.writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return root


__all__ = ["answer_rates", "committed", "current_status", "event_counts", "ingest", "ingest_batch", "ingest_tables", "job_states", "replay", "status_log"]
