"""Session plumbing shared by every part of the engine.

Nothing here touches data: it finds the folder that all executors share,
writes intermediate tables there, and ships the package to Python workers.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; production sessions come from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veritrail")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERITRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer parts than there are cores, as a single small file does, is dealt to all of them."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/veritrail/{label}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hpath)
    files.deleteOnExit(hpath)
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``options`` go to the writer.

    This cuts lineage and survives lost executors: later stages read files
    that no single machine owns. The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritrail/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/veritrail/" in f:
            hpath = jvm.org.apache.hadoop.fs.Path(f)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="veritrail-"), "veritrail.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
