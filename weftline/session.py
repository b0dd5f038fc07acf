"""Session helpers: the shared folder, cutting lineage and sizing shuffles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "weftline", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is named. Only a local
    session may go without: executors of a cluster wouldn't see this machine's folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        made = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage as checkpoint() does, outlives the loss of any executor, and keeps column pruning and
    compression. The job runs at once. The table is removed by ``release``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table behind what ``materialize`` returned, once nothing that has yet to run reads it."""
    path = getattr(df, "_stage", None)
    if path:
        _delete(df.sparkSession, path)
