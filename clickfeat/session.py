"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins/partition counts at run
# time and splits skewed join partitions; broadcast is never automatic beyond
# Spark's own size estimate (explicit broadcasts are size-checked in code).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # AQE may run a shuffled join as a hash join when every post-shuffle
    # partition of the build side is below this size (checked at run time)
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # remove checkpoint files once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "clickfeat",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Get or create a session with the engine's defaults.

    On a cluster pass ``master=None`` (the launcher decides) and size
    ``shuffle_partitions`` to roughly input_bytes / 128 MB; AQE coalesces
    from there.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in
    ``spark.checkpoint.dir``.  A local session without that setting (tests)
    gets a temporary one; any other master without it is an error, since a
    machine-local folder would be invisible to the other executors."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="clickfeat-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a staged table,
    under the folder exactly as configured (Hadoop resolves its scheme)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/clickfeat-stage/{name}-{uuid.uuid4().hex[:12]}"


# Bytes of a method up to which the JVM compiles it.
METHOD_BYTES = "8000"


@contextmanager
def compiled(spark: SparkSession):
    """For jobs of wide projections run within: where the code generated for a stage exceeds
    ``METHOD_BYTES``, its operators run one by one, in methods that the JVM compiles; one
    larger method would be interpreted for every row.  The setting is put back."""
    name = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(name)
    spark.conf.set(name, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a staged table through the file system that holds it."""
    if "/clickfeat-stage/" not in path:
        raise ValueError(f"not a staged table: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
