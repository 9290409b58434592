"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="curaspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder of its own under it, with its scheme."""
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/curaspark/{name}-{uuid.uuid4().hex}")
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()
