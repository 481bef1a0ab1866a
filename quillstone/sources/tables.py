"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to a scratch folder and read again: what several passes read is made once, and survives lost executors."""
    path = scratch(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
