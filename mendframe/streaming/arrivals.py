"""Repair of files as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.repair import repair
from ..sources.files import list_files


def _reject_empty(spark: SparkSession, source: str, path: str) -> None:
    """Add the empty files of the source that aren't in the table yet."""
    try:
        listed = list_files(spark, [source])
    except AnalysisException:  # nothing there yet
        return
    found = listed.filter("n_bytes = 0").select("file", "name", F.lit("empty").alias("reason"), F.lit(-1).cast("long").alias("arrived_in"))
    try:
        found = found.join(spark.read.parquet(path).select("file"), "file", "left_anti")
    except AnalysisException:  # the first ones
        pass
    if not found.isEmpty():
        found.write.mode("append").parquet(path)


def repair_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int = 1000,
                    **options) -> StreamingQuery:
    """Repair all files not seen before, then stop.

    Every micro-batch (at most ``max_files`` files) goes through
    :func:`mendframe.plans.repair.repair` and is written to ``target`` under
    ``rows``, ``files``, ``rejected`` and ``manifest``, in a folder of its batch
    number.  A repeated batch replaces its folder, so a restart neither loses
    nor doubles rows.  Files of zero bytes never reach a stream of contents; they are
    rejected from the listing, once, under ``arrived_in`` -1.
    """
    _reject_empty(spark, source, f"{target}/rejected/batch_id=-1")
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files).load(source).select("path", "length")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        # Names of one micro-batch, bounded by max_files.
        paths = [r["path"] for r in batch.select("path").collect()]
        if not paths:
            return
        result = repair(batch.sparkSession, paths, **options)
        parts = {"rows": result.rows, "files": result.files, "rejected": result.rejected,
                 "manifest": result.manifest()}
        for name, df in parts.items():
            df.withColumn("arrived_in", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/{name}/batch_id={batch_id}")

    return (files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
