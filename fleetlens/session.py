"""Session settings the operators rely on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# The largest number of points a series query may ask for; group limits up to this
# size are applied in the scan tasks.
GROUP_LIMIT = 2000

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": str(GROUP_LIMIT),
}


def session(app: str = "fleetlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. On a cluster, `spark-submit` sets the rest."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    A cluster names a shared one in `spark.checkpoint.dir`. Only where neither that nor
    a checkpoint directory is set, and Spark runs in local mode, a temporary folder of
    this machine is used.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    context.setCheckpointDir(folder)
    return folder
