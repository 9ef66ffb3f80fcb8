"""Sends the package to the executors, so that Python operators work wherever the driver can import it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
#: Bytes of an Arrow batch, unless the session sets a lower bound: texts are long, and every task holds two batches or three.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, and bounds the session's Arrow batches."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with the package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
