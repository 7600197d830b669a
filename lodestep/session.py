"""What every query needs of a session: shipped code, a shared folder, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of whole texts: Spark's own 64 MB for each of an executor's Python workers, and as much again for what they make of it, is too much.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that Python workers can import it anywhere.

    Arrow batches are cut to BATCH_BYTES in this session, unless it has a limit of its own.
    """
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit).rstrip("b") == str(64 << 20):
        spark.conf.set(limit, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="lodestep-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestep", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lodestep.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestep-shared-")
        spark.conf.set("lodestep.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lineage is cut, and the rows outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
