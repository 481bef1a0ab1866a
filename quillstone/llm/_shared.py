"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by settle(), by the run they belong to; None is for operators that are called by themselves.
_settled: dict[str | None, list[tuple[SparkSession, str]]] = {}
_run: list[str | None] = [None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of our own if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
            folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: While a table is written: finished executions give their shuffle files back at once, and Arrow batches are small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextlib.contextmanager
def _writing(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    try:
        for name, value in _WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors, and forgets how
    the rows were partitioned, so that joins on the result exchange both
    sides and adaptive execution may split a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillstone-{uuid.uuid4().hex[:12]}-{label}"
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    _settled.setdefault(_run[-1], []).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


@contextlib.contextmanager
def run(name: str):
    """Tables settled inside belong to the run of this name."""
    _run.append(name)
    try:
        yield
    finally:
        _run.pop()


def keep(df: DataFrame) -> None:
    """Exempt a settled frame's table from release()."""
    for tables in _settled.values():
        tables[:] = [x for x in tables if x[1] != df.settled_path]


def discard(*frames: DataFrame) -> None:
    """Delete the tables of settled frames that nothing reads any more."""
    for df in frames:
        keep(df)
        _delete(df.sparkSession, df.settled_path)


def release(name: str | None = None) -> None:
    """Delete all tables of a run. Call when no frame built on one will be read again; other runs' tables stay."""
    for spark, path in _settled.pop(name, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batch: pa.RecordBatch, column: str, most_chars: int = 2_000_000):
    """Parts of a batch with at most about so many characters each, with their texts; null counts as empty."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > most_chars:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def part_of(at: str = "at"):
    return F.shiftright(at, 33)


def number_rows(df: DataFrame, label: str, name: str = "n") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, ... in the order of df's partitions and of the rows in them; also how many there are.

    The rows are settled with their place in their partition first. Only one
    count a partition comes to the driver.
    """
    settled = settle(df.withColumn("at", F.monotonically_increasing_id()), label)
    counts = sorted(map(tuple, settled.groupBy(part_of().cast("int")).count().collect()))
    bases, total = [0] * (counts[-1][0] + 1 if counts else 1), 0
    for part, n in counts:
        bases[part] = total
        total += n
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return settled.withColumn(name, F.get(F.lit(bases), part_of().cast("int")).cast("long") + place).drop("at"), total
