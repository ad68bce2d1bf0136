"""Spark session helpers.

Everything in the library runs on whatever session the caller hands in; these
helpers only build a sensible one for tests, the bench and local runs, and
resolve the shared checkpoint folder that lineage cuts must use.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job on this library wants on every cluster.  AQE re-plans joins
# and coalesces partitions at runtime, and splits skewed join partitions
# (one host or class may hold a third of all flows).
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the tables that read them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast only what is small by construction; the size check below
    # is the hard limit Catalyst applies to everything else.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "flowlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use
    ``local[*]`` with a handful of shuffle partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in CLUSTER_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there; it is used as
    is.  Only on a local master, as in tests, a private folder is created when
    the setting is missing; a cluster without it is an error, since a folder
    of one machine would not be seen by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably (survives executor loss) and cut lineage.

    Uses ``DataFrame.checkpoint`` into the shared checkpoint folder; never a
    local checkpoint, whose blocks die with the executor that held them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files of a run go as soon as it ends, not when the driver next collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Materialize ``df`` like ``cut_lineage``, as Parquet below the checkpoint folder, and read it back.

    For tables that grow with the input: columns are compressed, later reads
    take only those they need, and the shuffle files of the run that wrote the
    table are removed with its end.  ``forget`` removes the table itself, else
    the end of the application does."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any column names
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        _written[path] = spark
        plain.write.parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._stored_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    _remove(_written.pop(df._stored_at), df._stored_at)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner cleans up then
            return


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables (column pruning and filter
    pushdown reach the scan because nothing is computed before it)."""
    return spark.read.parquet(table_path(sf_dir, name))
