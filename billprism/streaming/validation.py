"""The batch plan over a stream of files: every micro-batch is validated like a batch, and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import Options, validate
from ..plans.schematron import Ruleset
from ..sources.documents import from_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)


def start(files: DataFrame, rulesets: list[Ruleset], out: str, checkpoint: str, options: Options | None = None, available_now: bool = False) -> StreamingQuery:
    """Findings and results of each micro-batch go to ``out``/findings and ``out``/results in a folder of the batch's number, so a batch that runs
    again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.selectExpr("path as doc_id", "path as name", "content")
        found = validate(from_rows(rows), rulesets, options)
        try:
            found.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
            found.results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        finally:
            found.close()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, for streams and tables alike; ``ts`` is a timestamp."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", gap).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def counted(events: DataFrame, out: str, checkpoint: str, gap: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """A stream's counts by type and window, all that is there: each micro-batch merges into state, and the whole result replaces ``out``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return event_counts(events, gap, late).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; a temporary one only for a local master."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="billprism-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"
