"""Table access shared by all queries."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    Taken from ``spark.checkpoint.dir``. Only where that is unset (a local test session, which has
    no other machine) a temporary folder is used.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, once in a Spark context. Python functions of queries import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_sluice_shipped", False) or sc.master.startswith("local["):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    if package.is_dir():
        sc.addPyFile(shutil.make_archive(str(pathlib.Path(tempfile.mkdtemp(prefix="sluice-")) / "sluice_package"), "zip", package.parent, package.name))
    sc._sluice_shipped = True
