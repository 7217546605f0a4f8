"""Files that arrive in a folder, ingested as they come; windowed counts of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..warehouse import Warehouse

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, warehouse: Warehouse, checkpoint: str, pattern: str = "*.xlsx", refused: Callable[[str, EngineError], None] | None = None):
    """A query that ingests each new file once, whole batches together; a batch run twice finds its files by their hashes and writes nothing.

    A file without tables ends the query, or goes to ``refused`` with its error.
    """
    new = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder).select("path")

    def take(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # paths alone
        for path, done in zip(paths, warehouse.ingest_many(paths)) if paths else ():
            if "error" in done:
                if refused is None:
                    raise done["error"]
                refused(path, done["error"])

    return new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, key, n: for a stream, events later than ``late`` are left out; for a table, none are."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
