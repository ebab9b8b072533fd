"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse, which is shared as well."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


class Workspace:
    """Written tables of one run.

    Saving a table cuts the lineage: a lost executor re-reads the table and
    does not repeat the stages before it.  The tables of a run are removed
    by ``release`` or else when the driver ends.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.run_id = uuid.uuid4().hex
        self.path = f"{(root or shared_dir(spark)).rstrip('/')}/run-{self.run_id}"
        self._fs, self._root = self._file_system()
        self._fs.deleteOnExit(self._root)

    def _file_system(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove one table that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs.delete(path, True)

    def release(self) -> None:
        """Remove all tables of the run; results that read them can't be used any more."""
        self._fs.delete(self._root, True)
