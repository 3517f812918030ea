"""Shared pieces: staged tables in the cluster's shared folder, and memoised use of the public tokenizers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, as the body of a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a new one where that is unset and all tasks run on
    this machine. A cluster must name one, as its executors share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperlode-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperlode-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_key(col: str = "doc_id"):
    """An id that joins: null ids share the smallest long."""
    return F.coalesce(F.col(col).cast("long"), F.lit(-(2**63)))


_HELD: dict = {}


def held(key, make):
    """make(), kept in this Python worker until another key is asked for: a worker that goes on to other work holds
    one large object, not one for each kind of work that it has done."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give freed memory back to the system, as far as Arrow and the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Memo(dict):
    """key -> compute(key), kept for the last `cap` to 2*cap distinct keys: memory is bounded, results are not."""

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            self.make_room(1)
            self[key] = value
        return value

    def make_room(self, n: int) -> None:
        if len(self) + n > self.cap and self:
            self.old = dict(self)
            self.clear()
