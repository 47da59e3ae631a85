"""Reading and writing the tables: events, catalogue records, index, listing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import name_fault, parse_time, print_time
from ..operators.sequence import drop_incomplete_tail
from ..schemas import METADATA


def read_events(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_events(events: DataFrame, path: str, complete_only: bool = True, keys: list[str] | None = None) -> None:
    """Append, laid out by store and file; what lies behind a file's last transaction boundary is left for later."""
    rows = drop_incomplete_tail(events, keys).drop("boundary", "txn_in_file") if complete_only else events
    rows.write.mode("append").partitionBy(*(keys or []), "file_seq").parquet(path)


def write_files(files: DataFrame, path: str, keys: list[str] | None = None, dealt: bool = False, compression: str | None = None) -> None:
    """One JSON record a file, in a folder of its own below its store's, so that a file that is written again replaces only its record.

    Records are dealt to all tasks by a fixed number: they are few bytes, which adaptive plans would leave to one task, but each is a file to write.
    Records that hold long sets come ``dealt`` to tasks and are not exchanged again; ``compression`` (``gzip``) makes them smaller on disk, and ``read_files`` reads either.
    """
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select(
        *(keys or []), "name", F.lit(1).alias("version"), "size", *[c for c in ("previous_gtids", "added_gtids") if c in files.columns],
        print_time(F.col("min_ts")).alias("min_timestamp"), print_time(F.col("max_ts")).alias("max_timestamp"), "last_sequence_number",
    )
    rows = rows if dealt else rows.repartition(spread, *(keys or []), "name")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(keys or []), "name").json(path, compression=compression)


def read_files(spark: SparkSession, path: str, strict: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Catalogue records; a record that cannot be read or has another version than 1 raises, or is left out if not strict."""
    schema = T.StructType([*METADATA.fields, *[T.StructField(k, T.StringType()) for k in keys or []]])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    good = (F.col("version") == 1) & F.col("size").isNotNull()
    if strict:
        rows = rows.withColumn("version", F.when(F.coalesce(good, F.lit(False)), F.col("version")).otherwise(F.raise_error(F.lit("unsupported metadata")).cast("int")))
        rows = rows.filter("version = 1")
    else:
        rows = rows.filter(F.coalesce(good, F.lit(False)))
    return rows.select(*(keys or []), "name", "size", "previous_gtids", "added_gtids", parse_time(F.col("min_timestamp")).alias("min_ts"), parse_time(F.col("max_timestamp")).alias("max_ts"), "last_sequence_number")


POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The snapshot that a pointer names; None if nothing was ever published."""
    jvm, target, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name a snapshot that is wholly written: a file beside it takes its place by one rename, so readers see the old or the new one and never none."""
    jvm, target, fs = _hadoop(spark, f"{path}/{POINTER}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, options)


def write_index(files: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """``./name`` lines in order, as one text file for each store (a line for each log file).

    The lines become a new snapshot; only when it is whole does the pointer move to it.  A write that fails leaves the old index in force; the snapshot before last is deleted.
    """
    spark, keys = files.sparkSession, keys or []
    old = current_version(spark, path)
    version = f"index-{int(old.split('-')[1]) + 1 if old else 1:09d}-{uuid.uuid4().hex[:8]}"
    lines = files.select(*keys, "file_seq", F.concat(F.lit("./"), "name").alias("value"))
    dealt = lines.repartition(*keys) if keys else lines.repartition(1)
    rows = dealt.sortWithinPartitions(*keys, "file_seq").select(*keys, "value")
    (rows.write.partitionBy(*keys) if keys else rows.write).text(f"{path}/{version}")
    publish(spark, path, version)
    jvm, target, fs = _hadoop(spark, path)
    for status in fs.listStatus(target):  # snapshots: a few
        name = status.getPath().getName()
        if name.startswith("index-") and name not in (old, version):
            fs.delete(status.getPath(), True)


def read_index(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, entry, line_no, name`` in order; blank lines are skipped; faults are the audit's business.  ``path`` is a published index, or a plain text file or folder of such."""
    keys = keys or []
    version = current_version(spark, path)
    schema = T.StructType([T.StructField("value", T.StringType()), *[T.StructField(k, T.StringType()) for k in keys]])
    text = spark.read.schema(schema).text(f"{path}/{version}" if version else path, wholetext=True)
    lines = text.select(*keys, F.posexplode(F.split("value", "\n")).alias("line_no", "entry")).filter(F.trim("entry") != "")
    return lines.select(*keys, "entry", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("entry", r"^\./", "").alias("name"))


def index_faults(index: DataFrame) -> DataFrame:
    path = F.when(~F.col("entry").startswith("./"), "path").otherwise(name_fault(F.col("name")))
    return index.withColumn("fault", path).filter("fault is not null")


def list_store(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, name, size`` of the objects below ``path``; contents are not read, and unfinished (``.tmp``) ones do not count.  Keys are taken from folders ``key=value``."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    own = [F.regexp_extract("path", rf"/{k}=([^/]*)/", 1).alias(k) for k in keys or []]
    return found.select(*own, F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).filter(~F.col("name").endswith(".tmp"))


def apply_purge(files: DataFrame, victims: DataFrame, path: str, keys: list[str] | None = None) -> dict:
    """Commit the shortened index first, then drop the victims' partitions, store by store; a drop that fails leaves a warning, the purge stands."""
    spark, keys = files.sparkSession, keys or []
    rest = files.join(victims.select(*keys, "name"), [*keys, "name"], "left_anti")
    write_index(rest, f"{path}/index", keys)
    warning = None
    for row in victims.select(*keys, "file_seq", "name").toLocalIterator():  # names of the victims, one at a time
        store = "".join(f"{k}={row[k]}/" for k in keys)
        for part in (f"{path}/events/{store}file_seq={row.file_seq}", f"{path}/files/{store}name={row.name}"):
            _, target, fs = _hadoop(spark, part)
            try:
                if not fs.delete(target, True) and warning is None:
                    warning = f"could not delete {part}"
            except Exception as e:  # noqa: BLE001  best effort: the first message is told
                warning = warning or str(e).split("\n")[0]
    return {"status": "warning" if warning else "success", "message": warning}
