"""Tables written once into the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of applications on one machine that set none, by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a session on one machine may do without: it gets a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="meridian-")
    return _LOCAL[app]


def materialize(df: DataFrame) -> DataFrame:
    """Writes a frame as Parquet and reads it back: lineage ends there, and what several steps read is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/meridian-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
