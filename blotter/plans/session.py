"""Spark session settings for running the reports."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from blotter.plans.materialize import scratch_dir

CONF = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, switch joins to broadcast from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "blotter", extra: dict | None = None) -> SparkSession:
    """Local/test session; on a cluster pass ``master=None`` and cluster conf."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(CONF)
    if (master or "").split("[")[0] == "local":
        # Catalog metadata of the (external) fixture tables; keeps the working
        # directory clean.  On a cluster the deployment's warehouse applies.
        conf["spark.sql.warehouse.dir"] = os.path.join(tempfile.gettempdir(), "blotter-warehouse")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch one only when unset (tests)."""
    d = scratch_dir(spark)
    spark.sparkContext.setCheckpointDir(d)
    return d
