"""Session helpers: a tuned builder, the shared work folder, input spreading."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC, adaptive plans, skew-join handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@functools.cache
def _local_base(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="inkfold-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only a session in one process (``local[n]``), which has no other machine to share with, may leave that setting
    out and gets a temporary folder; any other session is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared work folder and read it back.

    What reads it several times does not make it several times, and a lost executor does not send the whole lineage
    back to the sources.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Setting that asks for a shuffle of the input into so many partitions.
INPUT_PARTITIONS = "spark.inkfold.input.partitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session asks for by INPUT_PARTITIONS; as it was scanned without it.

    A file with one row group is one task however many cores there are: only for such input is the setting of use.
    The plan does not depend on the size of the data.
    """
    asked = df.sparkSession.conf.get(INPUT_PARTITIONS, "")
    return df.repartition(int(asked)) if asked else df
