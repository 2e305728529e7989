"""Parquet readers, materialisation and size estimates."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory of files) of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one only where none is configured.

    A cluster names the folder in ``spark.checkpoint.dir``. The machine-local
    fallback is for ``local[...]`` masters alone, as in tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lodestat-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared checkpoint folder and read it back.

    Unlike a checkpointed RDD, the table has a known size, which the join strategy
    of later plans goes by, and its columns can be pruned. It is deleted with
    ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lodestat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def release(*dfs: DataFrame) -> None:
    """Delete tables made by ``materialise`` that no later plan reads."""
    for df in dfs:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lodestat-" in file:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once in each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="lodestat-")) / "lodestat.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes: file sizes, no job; where it has none, a count of rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 128 * df.count()


def bucket_count(df: DataFrame, *others: DataFrame, bytes_per_bucket: int = 16 << 20) -> int:
    """How many hash buckets keep each one near ``bytes_per_bucket`` at any input size, and all cores busy at a small one."""
    total = sum(plan_bytes(d) for d in (df, *others))
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(least, -(-total // bytes_per_bucket))
