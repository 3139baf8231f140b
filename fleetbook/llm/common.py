"""Helpers shared by the operators: shared tables, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a single-JVM local session (tests) gets a scratch
    folder of its own; any other session must name a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def store_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that ``pyarrow.fs.FileSystem.from_uri`` opens in tasks: a path without a
    scheme lies where Spark itself would put it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = uri.partition(":")
    rest = rest if rest.startswith("//") else "//" + rest
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, in buckets by a hash of ``key``, and read back.

    A grouping by ``key`` with another table then shuffles the other table only. The
    table is known to this session's catalog and lies in the shared folder.
    """
    path = new_path(df.sparkSession, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").option("path", path).bucketBy(shuffle_width(df.sparkSession), key).saveAsTable(table)
    return df.sparkSession.table(table)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a function that gets texts: its session sends Arrow batches of
    at most 2,000 rows and about 2 MB, unless they are set to be smaller, so a
    worker's memory does not grow with the lengths of the texts."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)):
        now = int(conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def id_text(col: str | Column) -> Column:
    """An id as text; a missing id as empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def id_crc(col: str) -> Column:
    """crc32 of the id as text (a null id as empty text)."""
    return F.crc32(id_text(col).cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def run_starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs: 0, l0, l0+l1, ... (one more than runs)."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (by sorting: much faster than ``np.unique`` on whole numbers)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` (0 for an empty run), each added up
    on its own, so that a run's sum doesn't depend on its neighbours."""
    lengths = np.diff(starts)
    out = np.zeros(len(lengths), dtype=values.dtype)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out
