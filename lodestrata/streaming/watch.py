"""Files as they arrive: the batch reader on a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify
from ..sources import reader

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of blocks of the files that appear in a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return reader.extract_files(stream)


def ledger_stream(blocks: DataFrame, out: str, checkpoint: str, language: str = "en") -> StreamingQuery:
    """Claims of each batch's sources; a source is a file, so it lies within one batch. A batch that is run again replaces its own folder."""

    def publish(batch: DataFrame, number: int) -> None:
        classify.claims(reader.classifier_input(batch, language)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return blocks.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
