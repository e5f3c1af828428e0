"""Where intermediate results go: the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The shared folder of the session.

    Only a local session, whose executors share the driver's disk, may go without one: it gets a temporary
    folder, made once. On a cluster a missing setting raises, since executors could not read such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


_own: list[str] = []


def checkpointed(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
