"""Session settings the operators are planned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pages are wide rows (tens of KB to MBs), so Arrow batches are bounded by bytes and
# by a low row count, and input splits stay small enough for one Python worker.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def build_session(app: str = "pagemill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS` where nothing else is set; *extra* is set in any case."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    given = session.conf.getAll
    for key, value in SETTINGS.items():
        if key not in given:
            session.conf.set(key, value)
    return session


def _is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path and not path.startswith(("hdfs:", "viewfs:"))


#: (application, folder) pairs known to be reached by all executors.
_REACHED: set[tuple[str, str]] = set()
#: The folder of each application in local mode that names none.
_OWN: dict[str, str] = {}


def _check_reached(spark: SparkSession, folder: str) -> None:
    """An error unless the driver finds in *folder* all that executors write there. Tried once per application."""
    tried = (spark.sparkContext.applicationId, folder)
    if tried in _REACHED:
        return
    path, tasks = f"{folder.rstrip('/')}/reached-{uuid.uuid4().hex}", max(2, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    probe = spark.read.schema("id long").parquet(path)
    if probe.count() != tasks:
        raise RuntimeError(f"{folder} is a local folder; set spark.checkpoint.dir to one that all executors reach")
    remove(probe)
    _REACHED.add(tried)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir`` or by ``setCheckpointDir``, else one in its
    warehouse; a fresh local one in local mode.

    On a cluster a local path may be a mount which all machines share, so it is tried, not refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master, application = spark.sparkContext.master, spark.sparkContext.applicationId
    on_one_machine = master == "local" or master.startswith("local[")  # not local-cluster
    if not configured and not on_one_machine:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pagemill-tables"
    if configured:
        if not on_one_machine and _is_local(configured):
            _check_reached(spark, configured)
        return configured
    if application not in _OWN:  # kept here: Spark takes no other value of this setting once it runs
        _OWN[application] = tempfile.mkdtemp(prefix="pagemill-")
    return _OWN[application]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """*df* written once to the shared folder and read back.

    Cuts the plan where a result is used several times; written files outlive lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a :func:`materialize` result that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, row_bytes: int, name: str, limit_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """*df* written out and counted; marked for broadcast only when it is small enough.

    Beyond the limit it comes back unmarked, and the join sorts and merges instead.
    """
    written = materialize(df, name)
    return F.broadcast(written) if written.count() * row_bytes <= limit_bytes else written
