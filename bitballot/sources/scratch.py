"""A folder for files that queries write and read back, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A new folder under spark.checkpoint.dir, deleted when the program ends; a temporary one in local mode without that setting."""

    def __init__(self, spark: SparkSession):
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark, self.root = spark, f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='bitballot-')}/files-{uuid.uuid4().hex}"
        atexit.register(self.delete)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def delete(self) -> None:
        try:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is the cluster's to clean
            pass
