"""Monthly files as they arrive: a stream of file names, each batch of which is loaded by the files' own headers and the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from turnflow.constants import CARRIERS
from turnflow.sources.ledger import load_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_months(spark: SparkSession, folder: str, flights: str, checkpoint: str, once: bool = True, files_at_once: int = 100, carriers: Sequence[str] = CARRIERS) -> StreamingQuery:
    """Appends the files of a folder to the table at `flights`, so many at once. A month may come in several files, now or later; a batch
    that is run again adds nothing twice. The stream carries names only: their contents are read in the load."""
    names = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once).load(folder).select("path")

    def add(batch: DataFrame, _: int) -> None:
        paths = [r.path for r in batch.collect()]  # files_at_once at most
        if paths:
            load_files(batch.sparkSession, paths, flights, carriers, again="add", literal_paths=True)

    out = names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
