"""Session settings and tables staged in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tidelog", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE with skew handling, and Arrow transfer; ``conf`` adds or overrides settings (``__`` for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application; they may run where it isn't installed."""
    sc = spark.sparkContext
    if _shipped.get("application") != sc.applicationId:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="spark-tidelog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "tidelog"), "zip", os.path.dirname(root), os.path.basename(root)))
        _shipped["application"] = sc.applicationId


_shipped: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. In a local session without one, a temporary folder is made for the life of the process.

    A cluster without the setting is an error: a folder of one machine would be lost with it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidelog.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        made = tempfile.mkdtemp(prefix="spark-tidelog-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        at = "file://" + made
        spark.conf.set("tidelog.shared.dir", at)
    return at.rstrip("/")


def staged_path(spark: SparkSession) -> str:
    """A new path in the shared folder, released with the staged tables."""
    return f"{shared_folder(spark)}/tidelog-{spark.sparkContext.applicationId}/{uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a read of it.

    Cuts the lineage like ``checkpoint()``, survives the loss of executors, is compressed, and later
    reads prune its columns. Use it where one result feeds several branches of a plan.
    """
    path = staged_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, name: str, build) -> DataFrame:
    """The table that ``build()`` gives, staged at the first call of this application with this ``name`` and read again by later ones."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _once:
        _once[key] = stage(build())
    return _once[key]


_once: dict[tuple[str, str], DataFrame] = {}


def release_staged(spark: SparkSession) -> None:
    """Delete the tables that this application has staged; results still to be read must not depend on them."""
    for key in [k for k in _once if k[0] == spark.sparkContext.applicationId]:
        del _once[key]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidelog-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cluster(df: DataFrame, keys: list[str], order: list[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with equal ``keys`` in one partition, sorted by them and ``order``, for mapInArrow over sorted groups.

    Spark leaves out a repartition whose child is partitioned that way already, and a sort likewise; but when it
    then turns the join below into a broadcast join at run time, nothing above demands either and groups are
    torn. A hash of the keys is a partitioning that no child has, so the shuffle and the sort stay. A given
    number of ``partitions`` is kept, where Spark would put small ones together.
    """
    spread = [F.xxhash64(*keys)] if partitions is None else [partitions, F.xxhash64(*keys)]
    return df.repartition(*spread).sortWithinPartitions(*keys, *order)
