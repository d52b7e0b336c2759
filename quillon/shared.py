"""What every part of the package needs from a session: its code on the workers, and a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of this session the package, so that executors need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._quillon_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a session whose tasks run
    in the driver's own process gets a new local folder (as in tests); on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillon.shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("quillon.shared", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: a lost executor costs no more than what comes after it."""
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
