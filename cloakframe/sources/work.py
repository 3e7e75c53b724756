"""Folders for data that a job hands from one step to the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``. Where that is
    unset, a local master gets a temporary folder and a cluster one in the warehouse. It is
    deleted when the application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        local = sc.master.startswith("local") and "cluster" not in sc.master
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="cloakframe-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_cloakframe"
        base = _own[sc.applicationId]
    path = f"{base.rstrip('/')}/cloakframe-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
