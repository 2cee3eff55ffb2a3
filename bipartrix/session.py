"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bipartrix", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; keyword keys have ``__`` for ``.``."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="bipartrix-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a local master may leave it unset; it then gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = _local_folder()
        sc.setCheckpointDir(root)
    out = df.checkpoint()
    out._is_cut = True
    return out
