"""Shared folders, durable intermediate results and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master only."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or shared_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids (16 bytes each) that may be broadcast instead of shuffling the texts they are joined with.
BROADCAST_IDS = 2_000_000


def ids_side(ids: DataFrame) -> DataFrame:
    """Distinct ids, held durably, as a broadcast side if their count allows it, else as they are."""
    ids = durable(ids.distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
