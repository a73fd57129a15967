"""Session settings and the staging of intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all of them may be changed while a session runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # streams that are joined wait for the slowest one, so none of its rows are late
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}


def session(app: str = "candlemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. ``master`` is only for local use; a cluster names its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session somebody else made."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    _ship_package()
    return spark


def _ship_package() -> None:
    """Let Spark send this package's functions along with the tasks that call them, so that nothing
    needs to be installed on the workers (nor for the driver-side worker of stateful streams)."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


# Per application: the folder made where the cluster names none, and the tables staged so far.
_made: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Only a session on this one machine (``local[...]``) that names none gets a temporary folder, made once per
    application. Anywhere else a folder of one machine would be invisible to the others, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not single_machine(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        named = _made.get(app) or _made.setdefault(app, tempfile.mkdtemp(prefix="candlemill-"))
    return named.rstrip("/")


def single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; ``drop_staged`` deletes what is written there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and continue from the file.

    Used where a result feeds several passes: the trades behind it are then scanned once, each pass
    still prunes its own columns, and a lost executor re-reads the file instead of the trades.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this application put into the shared folder, once nothing reads it any more."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
