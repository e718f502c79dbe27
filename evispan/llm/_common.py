"""Helpers shared by the operators of this subpackage.

Rows cut from their lineage go to a written table below ``spark.checkpoint.dir``, which every
executor and the driver can see; a lost executor then only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut tables: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a temporary folder is made, and only under a ``local`` master, where driver and
    executors are one process; a real cluster without the setting is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evispan-")
        spark.conf.set(key, found)
    return found.rstrip("/")


#: Whether Spark drops an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back. Nothing reads the shuffles behind it again, so
    Spark drops their files as soon as the table is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._evispan_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_evispan_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under names of our own: other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut so that a slice has about ``most`` characters (one row at least), with the column as a list. Only a slice's
    values are Python objects at a time."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.utf8_length(values), 0).to_numpy(zero_copy_only=False).tolist()
        start = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= most or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start), values.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
