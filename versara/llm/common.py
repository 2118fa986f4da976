"""Helpers shared by the corpus operators: shared tables, safe batches and shipping of this package."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a temporary folder is taken in local mode only; on a cluster a
    machine-local folder would lose data, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="versara-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/versara/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a finished execution gives its shuffle files back at once.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds inside the block only."""
    was = spark.conf.get(name) if spark.conf.isModifiable(name) else None
    if was is None:
        yield
        return
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def write_cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back: lineage ends here, so a lost
    executor costs no recomputation of what stands above, and the shuffles that led here are given back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_cuts(*tables: DataFrame) -> None:
    """Deletes tables that ``write_cut`` returned, once all that reads them has been written itself."""
    for t in tables:
        drop_path(t.sparkSession, t._written_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's own default of rows in a batch for Python, and ours: a batch holds whole texts.
DEFAULT_BATCH, TEXT_BATCH = "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters where it isn't installed; and
    keeps batches of texts small unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = f"{shared_dir(spark)}/versara/{root.name}-{uuid.uuid4().hex}.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(batches, limit: int = 1 << 22):
    """Cuts record batches into slices of about ``limit`` bytes, so that Python objects made from a batch
    of long texts stay small. Every row is kept, in order. At the end of the task, memory that allocators
    hold goes back to the system, as workers live on."""
    try:
        for batch in batches:
            rows, size = batch.num_rows, batch.nbytes
            step = max(1, rows * limit // max(size, 1))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


#: Quantiles that one sketch is asked for; more are found range by range.
COARSE = 1024


def id_bounds(rows: DataFrame, bucket_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest ids of consecutive id ranges of about ``bucket_rows`` rows, ascending, and of how many such
    ranges each of them alone is worth (over 1 for an id that is repeated so often). The last is the greatest id
    of all; each bound is an id that occurs. Reads ids only. Beyond ``COARSE`` ranges, coarse ones are found first
    and cut apart in parallel, so no sketch grows with the table; the bounds that reach the driver take 8 bytes
    for ``bucket_rows`` rows. No ids: empty."""
    known = rows.where("doc_id is not null").select("doc_id")
    parts = max(1, -(-count_rows(known) // bucket_rows))

    def cuts(n: int) -> list[float]:
        return [(i + 1) / n for i in range(n)]

    coarse = min(parts, COARSE)
    found = known.agg(F.percentile_approx("doc_id", cuts(coarse), 20 * COARSE).alias("q"), F.max("doc_id").alias("m")).first()
    if found.m is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every = [*found.q, found.m] if found.q[-1] != found.m else list(found.q)
    if parts > COARSE:
        edges, fine = np.array(sorted(set(every)), np.int64), -(-parts // coarse)

        @F.pandas_udf("int")
        def range_of(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, ids.to_numpy()))

        cut = known.groupBy(range_of("doc_id").alias("r")).agg(F.percentile_approx("doc_id", cuts(fine), 20 * COARSE).alias("q"), F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
        every = []
        for r in cut.collect():  # one row per coarse range
            every += [*r.q, r.m] if r.q[-1] != r.m else r.q
    values, counts = np.unique(np.array(every, np.int64), return_counts=True)
    return values, counts
