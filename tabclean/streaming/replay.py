"""O-82: apply a preset to new CSV files with Structured Streaming.

The stream carries paths only (the binary-file source reads no content when
none is asked for). ``foreachBatch`` cleans the new files together with the
batch cleaner, so encoding, header, quoting and statistics are those of each file
alone (a preset stores options, not statistics), and a batch of many files costs the jobs
of one. Output is kept by file, log and dead letters by batch: a retried batch (lost executor,
restarted query) rewrites the same folders, and the stream's checkpoint records which
files are done. Stateless per batch: no watermark or state store is needed.

A file that cannot be cleaned goes to the dead-letter table with its reason and
the stream goes on; a restart does not meet it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabclean.plans.request import CleanRequest
from tabclean.session import scratch_dir
from tabclean.sources.batch import clean_batch

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LOG_SCHEMA = "batch_id bigint, path string, step_no int, name string, details string"
DEAD_SCHEMA = "batch_id bigint, path string, reason string"
# A batch costs about the same jobs for one file or thousands; its paths, reasons and logs are a few rows a file on the driver.
FILES_PER_BATCH = 10_000


def replay_stream(spark: SparkSession, in_dir: str, request: CleanRequest, out_dir: str,
                  checkpoint: str | None = None, files_per_batch: int = FILES_PER_BATCH) -> dict:
    """Clean every CSV file under ``in_dir`` (available now) with ``request``.

    Rows go to ``rows/source=<file>``, the step log to ``log/batch=<id>`` and files that failed to
    ``dead_letter/batch=<id>`` under ``out_dir``; returns the number of batches and the checkpoint folder.
    """
    request = request.validate()
    checkpoint = checkpoint or scratch_dir(spark, "replay-checkpoint")
    out_dir = out_dir.rstrip("/")
    stream = (spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("pathGlobFilter", "*.csv")
              .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
              .load(in_dir).select("path"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [row["path"] for row in batch.collect()]  # at most files_per_batch
        done = clean_batch(spark, paths, request, f"{out_dir}/rows")
        log = [(batch_id, p, i + 1, n, d) for p, (reason, steps) in done.items() if not reason for i, (n, d) in enumerate(steps)]
        dead = [(batch_id, p, reason) for p, (reason, _) in done.items() if reason]
        for rows, schema, kind in ((log, LOG_SCHEMA, "log"), (dead, DEAD_SCHEMA, "dead_letter")):
            if rows:
                spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{out_dir}/{kind}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return {"batches": len(query.recentProgress), "checkpoint": checkpoint}
