"""What the training-data operators share: shared storage, bounded Arrow batches, label samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or in a local session (tests) one of our own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def posix_path(path: str) -> str:
    """The local mount of a shared path; raises for stores that are not mounted."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {parts.scheme}://")
    return parts.path if parts.scheme else path


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of df's, compared without case as Spark does."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): the only columns that scoring operators read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most max_bytes of the column each (one row may be larger)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def append_column(docs: DataFrame, text_col: str, name: str, kind: str, function) -> DataFrame:
    """docs with one more column: function(list of text bytes or None) -> values, run over bounded Arrow slices.

    All other columns pass through untouched. name must not clash (see unused_name).
    """
    columns = docs.columns
    work = unused_name(docs, "text_bytes")
    source = docs.withColumn(work, F.col(text_col).cast("binary"))
    schema = docs.select("*", F.lit(None).cast(kind).alias(name)).schema

    def run(batches):
        make = function()
        for batch in bounded(batches, work):
            values = make(batch.column(batch.schema.get_field_index(work)).to_pylist())
            arrays = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(values)], names=[*columns, name])

    return source.mapInArrow(run, schema)


def fold_of(column) -> F.Column:
    """crc32 of the id as text, modulo 5; null ids fall in fold 0 (held out of training)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def sample_labels(labels: DataFrame, label_col: str, limit_per_class: int, classes: tuple[int, ...] = (0, 1)) -> list[tuple[int, int]]:
    """(doc_id, label) of at most limit_per_class rows of each of the classes outside the held-out fold.

    Chosen by a hash of the id, so reruns agree. Rows with a null id or label are passed over; repeated
    labels of an id count by majority, ties as 1. Both lists are bounded, so the driver may hold them.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y"))
        .where(fold_of(F.col("doc_id")) != 0)
    )
    rows: list[tuple[int, int]] = []
    for y in classes:
        picked = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit_per_class)
        rows += [(r.doc_id, y) for r in picked.collect()]
    return rows


def sampled_texts(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text binary, y int) of the sampled ids; the broadcast side is the bounded sample."""
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample, "doc_id long, y int")
    return text_bytes(docs).join(F.broadcast(ids), "doc_id")

