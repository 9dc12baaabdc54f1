"""Folders for what a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the session's executors share (spark.checkpoint.dir). Where none is set, on this machine, if that runs all tasks; else ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="datewright-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        base = _own["dir"]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path of a folder as files are opened by."""
    return path.removeprefix("file://").removeprefix("file:")
