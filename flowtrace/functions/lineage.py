"""Lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one where the session names none, in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowtrace-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a table of keys is sent to what it selects from.
SENT = 100_000


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast where they are no more than SENT. keys are counted here, so they should be of a cut or stored table."""
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again, for loops that join what they have made.

    A checkpoint keeps the plan's estimate of its size, which such loops multiply without end; a table has its true size.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
