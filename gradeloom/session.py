"""Shared storage for written intermediate tables, and shipping of this package to the tasks."""

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import gradeloom

_local_dirs: dict[str, str] = {}


def ship_package() -> None:
    """Send this package's functions to the Python workers along with the calls that use them.

    Only needed when the package is neither installed on the cluster nor given with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(gradeloom)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="gradeloom-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other job uses, below the shared folder."""
    return f"{shared_dir(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later actions do not compute it again.

    This is the step between generating and scoring: a lost executor costs a re-read, never a second
    model call, and two scorings of one run read the same text.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
