"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is this machine alone (tests), a local temporary folder becomes that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that the running operators have written, by operator, the innermost last.
_scratch: list[list[str]] = []


#: Rows that one Arrow batch has where a table is written.
BATCH = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Python workers get batches of few rows meanwhile: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(operator):
    """For operators with small results: the result becomes a table, and the tables written on the way to it go."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        _scratch.append([])
        try:
            result = operator(docs, *args, **options)
            path = shared_dir(docs.sparkSession, operator.__name__)
            with small_batches(docs.sparkSession):
                result.write.option("compression", "zstd").parquet(path)
        finally:
            for old in _scratch.pop():
                drop_folder(docs.sparkSession, old)
        if _scratch:
            _scratch[-1].append(path)
        return docs.sparkSession.read.schema(result.schema).parquet(path)

    return run


def give_back() -> None:
    """Return memory that this Python worker has freed to the system: workers live on from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(stream, rows: int = 1000):
    """The batches of a mapInArrow stream in parts of fewer rows, so that what is made from them stays small."""
    give_back()
    for batch in stream:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a written table (compressed) up to which it may be broadcast, and those that it may take in memory as a broadcast table.
SMALL, IN_MEMORY = 4 << 20, 16 << 20


def written_bytes(df: DataFrame) -> int:
    """Size of the files behind a written table, or an upper bound for a filter or selection of it, from the plan: no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _held(kind: T.DataType, column: Column) -> Column | int:
    """Bytes of a value behind its eight in the row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = F.size(column) if not isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0)))
        return F.coalesce(F.greatest(F.lit(0), inner).cast("long") * (1 if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else 8), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return 8 + sum((8 + _held(f.dataType, column[f.name]) for f in kind.fields), 0)
    return 0


def memory_bytes(df: DataFrame) -> int:
    """About what ``df`` takes as a broadcast table with its index: its rows are counted by a job, as files tell little of it."""
    row = sum((_held(f.dataType, df[f"`{f.name}`"]) for f in df.schema.fields), F.lit(64 + 16 * len(df.columns)).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def is_small(df: DataFrame, most: int = SMALL, memory: int = IN_MEMORY) -> bool:
    """Whether ``df`` (a written table, or columns of one) is to be broadcast: by its files where they leave no doubt, else by its rows."""
    size = written_bytes(df)
    return size <= most and (size * 128 <= memory or memory_bytes(df) <= memory)


def sized(df: DataFrame, most: int = SMALL, memory: int = IN_MEMORY) -> DataFrame:
    """``df`` (a written table, or columns of one) marked for broadcast if it is small, and against it if not: Spark itself goes by the bytes of compressed files."""
    return F.broadcast(df) if is_small(df, most, memory) else df.hint("merge")


def left_join_sized(left: DataFrame, right: DataFrame, keys: list[str], most: int = SMALL, salts: int = 16) -> DataFrame:
    """Left join whose right side is a written table with one row for each key (or few).

    A small one is broadcast; else both sides are shuffled with a salt, so that a key with a third of the left rows is spread (``salts=1``: no key has many).
    Spark sizes the salted side as if it were there once, so it is told not to broadcast it.
    """
    if is_small(right, most):
        return left.join(F.broadcast(right), keys, "left")
    if salts == 1:
        return left.join(right.hint("merge"), keys, "left")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a hash, not a random number: a task that runs again must deal its rows as before
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in keys]), F.lit(salts)).cast("int"))
    return spread.join(salted.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
