"""Getting the package to where Python runs on the cluster, and shared space for what is written in between."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers once for each application, by Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_CHECKPOINT = "spark.checkpoint.dir"


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the whole cluster shares (``spark.checkpoint.dir``).

    Where that setting is missing, a local temporary folder is chosen if Spark runs in one process, as in tests; on a cluster that is refused.
    """
    base = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{_CHECKPOINT} has to name a folder that all of the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set(_CHECKPOINT, base)
    # with its scheme, so that code outside Spark means the same place
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/seqloom-{uuid.uuid4().hex}"
