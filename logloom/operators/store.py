"""Stores: index, metadata and objects held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_fault

MARKER, INDEX = "metadata.json", "binlog.index"


def reconcile_store(index: DataFrame, files: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``name`` with which of the three know it, and both sizes."""
    on = [*(keys or []), "name"]
    i = index.select(*on).distinct().withColumn("in_index", F.lit(True))
    m = files.select(*on, F.col("size").alias("recorded_size")).withColumn("in_metadata", F.lit(True))
    o = listing.select(*on, F.col("size").alias("object_size")).withColumn("in_store", F.lit(True))
    all_three = i.join(m, on, "full_outer").join(o, on, "full_outer")
    known = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return all_three.select(*on, known("in_index"), known("in_metadata"), known("in_store"), "recorded_size", "object_size")


def missing_objects(index: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    on = [*(keys or []), "name"]
    return index.select(*on).join(listing, on, "left_anti")


def orphan_objects(index: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    on = [*(keys or []), "name"]
    return listing.join(index, on, "left_anti").select(*on, "size")


def load_files(index: DataFrame, files: DataFrame, strict: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Catalogue rows of the index's files.  Tolerant: those without good metadata are left out; strict: they raise."""
    on = [*(keys or []), "name"]
    rows = index.select(*on, "line_no").join(files, on, "left_semi" if not strict else "inner")
    if strict and not index.join(files, on, "left_anti").isEmpty():
        raise ValueError("metadata is missing")
    return rows.select(*rows.columns)


def _rows(df: DataFrame, keys: list[str], rule: str, detail: str = "") -> DataFrame:
    return df.select(*keys, F.lit(rule).alias("rule"), F.col("name").cast("string").alias("name"), F.lit(detail).alias("detail"))


def audit_store(index: DataFrame, files: DataFrame, listing: DataFrame, mode: str = "gtid", stored_mode: str | None = None, marker: bool = True, index_found: bool = True, keys: list[str] | None = None, stores: DataFrame | None = None) -> DataFrame:
    """``keys, rule, name, detail`` of every broken store rule V0 to V10.

    What holds for a store as a whole (V0 to V2) comes from ``stored_mode, marker, index_found``: arguments for one store, columns of ``stores`` (a row for each store) for many.

    ``index``: ``keys, entry, line_no, name``; ``files``: ``keys, name, size, added_gtids``; ``listing``: ``keys, name, size`` of log objects.
    """
    keys = keys or []
    spark = index.sparkSession
    facts = []
    if stored_mode is not None and stored_mode != mode:
        facts.append(("V0", None, stored_mode))
    if not marker:
        facts.append(("V1", None, MARKER))
    if not index_found:
        facts.append(("V2", None, INDEX))
    three = reconcile_store(index, files, listing, keys)
    parts = [
        index.withColumn("fault", F.when(~F.col("entry").startswith("./"), "path").otherwise(name_fault(F.col("name")))).filter(F.col("fault").isNotNull() & (F.col("name") != INDEX)).select(*keys, F.lit("V3").alias("rule"), "name", F.col("fault").alias("detail")),
        _rows(index.filter(F.col("name") == INDEX), keys, "V4"),
        _rows(index.groupBy(*keys, "name").count().filter("count > 1"), keys, "V5"),
        _rows(three.filter("in_index AND NOT in_store"), keys, "V6"),
        _rows(three.filter("in_store AND NOT in_index"), keys, "V7"),
        _rows(three.filter("in_index AND NOT in_metadata"), keys, "V8", "missing"),
        _rows(three.filter("in_metadata AND NOT in_index"), keys, "V8", "orphaned"),
        _rows(three.filter("in_index AND recorded_size <> object_size"), keys, "V9"),
        _rows(files.filter(F.col("added_gtids").isNull() if mode == "gtid" else F.col("added_gtids").isNotNull()), keys, "V10"),
    ]
    if stores is not None:
        whole = lambda rule, bad, name, detail: stores.filter(bad).select(*keys, F.lit(rule).alias("rule"), F.lit(name).alias("name"), detail.cast("string").alias("detail"))
        parts += [whole("V0", F.col("stored_mode") != mode, None, F.col("stored_mode")), whole("V1", ~F.col("marker"), None, F.lit(MARKER)), whole("V2", ~F.col("index_found"), None, F.lit(INDEX))]
        parts[-3:] = [p.withColumn("name", F.col("name").cast("string")) for p in parts[-3:]]
    if facts:
        parts.append(spark.createDataFrame(facts, "rule string, name string, detail string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
