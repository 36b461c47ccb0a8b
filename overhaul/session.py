"""Session construction and the few settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. ANSI mode makes decimal overflow and bad date
# text raise, as the original database does; UTC keeps timestamp literals stable.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles (a month of orders, per-group rounds) still spread over
    # the cores; large shuffles are far above this and are unaffected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "overhaul", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the package defaults.

    On a cluster pass no master and let the launcher decide; size
    ``shuffle_partitions`` so one reducer partition stays around 128-256 MB of
    shuffle data (AQE coalesces downward from there).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in conf.items():
        if not key.startswith("spark.ui") and not key.startswith("spark.driver"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf of an already running context
                pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it on the context.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    one machine runs everything, may do without (a fresh scratch folder); on a
    cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="overhaul-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared checkpoint folder
    and return a DataFrame reading it.

    This cuts the lineage like ``checkpoint()`` but with a single computation
    (a reliable RDD checkpoint of an unpersisted Dataset computes it twice),
    and the files survive the loss of any executor.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/overhaul-{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
