"""Session helpers: table access, the shared folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the driver's parquet tables. spread: for work that costs much more than reading, rows
    of a table with fewer splits than the cluster has cores (a small file of one row group, say)
    are dealt out to all cores; a table with enough splits is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the session names it in spark.checkpoint.dir.

    Only a local session may lack it (tests); it then gets a temporary folder. On a cluster a
    missing setting is an error, since a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back: lineage ends there,
    and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    sc = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
