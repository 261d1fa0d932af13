"""Session settings and the shared folder for checkpoints and stores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "shelfwise", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time.

    Nothing here names a partition count: on a cluster the count is left to the
    submitter and to adaptive coalescing, local callers pass their own.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    It is taken as it is: a ``file:`` path may be a mount that all machines have. If
    it is unset, a local session gets a folder of its own, once; on a cluster
    a machine-local folder would lose data, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="shelfwise-")
        configured = _LOCAL_DIRS[app]
    return configured.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
