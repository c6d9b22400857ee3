"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python strings are handled in groups of at most so many bytes (one text may exceed it alone), and of so many texts.
GROUP_BYTES, GROUP_TEXTS = 500_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chronoframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, and no lineage to lose.

    The folder's path is added to ``into``, for ``discard`` when nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def groups(texts: pa.Array, most_bytes: int = GROUP_BYTES, most_texts: int = GROUP_TEXTS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive groups of a column's texts with their first index; null becomes the empty text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    first, size = 0, 0
    for i, n in enumerate([*sizes, 0]):
        if i > first and (i == len(sizes) or size + n > most_bytes or i - first == most_texts):
            yield first, [t or "" for t in texts.slice(first, i - first).to_pylist()]
            first, size = i, 0
        size += n


def small_batches(docs: DataFrame, rows: int = 1_000) -> DataFrame:
    """``docs``; its session gives Python Arrow batches of at most so many rows from now on, as texts can be long."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def lean(run):
    """The same batches from ``run``; at a task's end its allocators give back what they keep, since workers wait for more tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def labelled_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """About ``per_label`` rows of each label, by a hash of the key: the same rows on every run, and no sort.

    ``per_label`` bounds a classifier's training sample (in expectation); labels are few (they are the model's classes).
    """
    counts = rows.groupBy(F.col(label).alias("_ls_label")).agg(F.count("*").alias("_ls_n"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    joined = rows.join(F.broadcast(counts), F.col(label) == F.col("_ls_label"))
    return joined.where(place < F.lit(float(per_label)) / F.col("_ls_n")).drop("_ls_label", "_ls_n")
