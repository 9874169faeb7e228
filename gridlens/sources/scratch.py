"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_given: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in a temporary one only where a session on one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = f"{tempfile.gettempdir()}/gridlens-{os.getpid()}"
    _given.append(f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _given[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this driver put in its paths so far; for when the results that read them have been used."""
    while _given:
        path = spark._jvm.org.apache.hadoop.fs.Path(_given.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in that folder, read back: whatever is done again later meets the same rows."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
