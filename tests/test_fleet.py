"""Many stores at once: refusals by store, indexes that survive a crash."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import files as fl
from logloom.sources import tables as tb

U = "11111111-aaaa-1111-aaaa-111111111111"


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [("A", i, f"binlog.{i:06d}", 100 * i, i) for i in range(1, 6)] + [("B", i, f"binlog.{i:06d}", 7 * i, i + 100) for i in range(1, 4)] + [("C", i, f"other.{i:06d}", 9, i) for i in range(1, 3)]
    files = spark.createDataFrame(rows, "store string, file_seq long, name string, size long, t long").withColumn("min_ts", F.timestamp_seconds(F.col("t") * 86400)).withColumn("max_ts", F.col("min_ts")).withColumn("last_sequence_number", F.col("file_seq"))
    added = files.select("store", "file_seq", F.lit(U).alias("uuid"), F.lit("").alias("tag"), F.when(F.col("store") == "B", F.col("file_seq") + 10).otherwise(F.col("file_seq")).alias("lo")).withColumn("hi", F.col("lo"))
    return files, added


def test_no_store_loses_its_last_file(fleet):
    files, _ = fleet
    with pytest.raises(fl.CatalogueError, match=r"cannot purge the last file \(store=B\)"):
        fl.plan_purge(files.filter("store <> 'C'"), "binlog.000003", ["store"])
    got = fl.plan_purge(files, "binlog.000003", ["store"], check=False).collect()
    assert sorted((r.store, r.file_seq) for r in got) == [("A", 1), ("A", 2), ("A", 3)]
    told = {r.store: r.message for r in fl.purge_faults(files, "binlog.000003", ["store"]).collect()}
    assert told == {"B": "cannot purge the last file", "C": "base name differs"}


def test_refusals_of_one_store(spark, fleet):
    files, added = (df.filter("store = 'A'").drop("store") for df in fleet)
    asked = {
        "cannot parse GTID set": lambda: fl.search_by_gtid_set(files, added, "junk"),
        "Binlog storage is empty": lambda: fl.search_by_gtid_set(files.limit(0), added, ""),
        "GTID set search is not supported in storages created in position-based replication mode": lambda: fl.search_by_gtid_set(files, added, "", mode="position"),
        "The specified GTID set cannot be covered": lambda: fl.search_by_gtid_set(files, added, f"{U}:1-9223372036854775807"),
        "Invalid timestamp format": lambda: fl.search_by_timestamp(files, "yesterday"),
        "Timestamp is too old": lambda: fl.search_by_timestamp(files, "1970-01-01T00:00:00"),
        "cannot purge the last file": lambda: fl.plan_purge(files, "binlog.000005"),
        "no such file": lambda: fl.plan_purge(files, "binlog.999999"),
        "base name differs": lambda: fl.plan_purge(files, "other.000001"),
    }
    for message, ask in asked.items():
        with pytest.raises(fl.CatalogueError) as e:
            ask()
        assert str(e.value) == message
    with pytest.raises(fl.CatalogueError, match="^Binlog storage is empty$"):
        fl.plan_purge(files.limit(0), "binlog.000001")
    assert [r.file_seq for r in fl.search_by_gtid_set(files, added, f"{U}:2-3").collect()] == [2, 3]
    broken = added.withColumn("lo", F.raise_error(F.lit("disk on fire")).cast("long"))
    with pytest.raises(Exception, match="disk on fire"):  # a failure is no refusal
        fl.search_by_gtid_set(files, broken, f"{U}:1")


def test_refusals_of_stores(spark, fleet):
    files, added = fleet
    with pytest.raises(fl.CatalogueError, match=r"Timestamp is too old \(store=B\)"):
        fl.search_by_timestamp(files, "1970-01-04T00:00:00", ["store"])
    got = fl.search_by_timestamp(files, "1970-01-04T00:00:00", ["store"], check=False).collect()
    assert sorted((r.store, r.file_seq) for r in got) == [("A", 1), ("A", 2), ("A", 3), ("C", 1), ("C", 2)]
    wanted = spark.createDataFrame([(U, "", 1, 2)], "uuid string, tag string, lo long, hi long")
    told = [(r.store, r.message) for r in fl.gtid_faults_of_stores(files, added, wanted, keys=["store"], stores=spark.createDataFrame([("Z",)], "store string")).orderBy("store").collect()]
    assert told == [("B", "The specified GTID set cannot be covered"), ("Z", "Binlog storage is empty")]
    with pytest.raises(fl.CatalogueError, match="store=B"):
        fl.search_by_gtid_set(files, added, wanted, keys=["store"])


def test_index_survives_a_failed_write(spark, fleet, tmp_path):
    files = fleet[0].filter("store = 'A'").drop("store")
    path = f"file://{tmp_path}/index"
    tb.write_index(files.filter("file_seq < 4"), path)
    bad = files.withColumn("name", F.when(F.col("file_seq") == 5, F.raise_error(F.lit("crash")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="crash"):
        tb.write_index(bad, path)
    assert [r.name for r in tb.read_index(spark, path).orderBy("line_no").collect()] == [f"binlog.{i:06d}" for i in (1, 2, 3)]
    for n in (4, 5, 6):
        tb.write_index(files.filter(F.col("file_seq") < n), path)
    assert tb.read_index(spark, path).count() == 5
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("index-")]) == 2  # the one in force and the one before


def test_purge_of_a_fleet(spark, fleet, tmp_path):
    files, _ = fleet
    path = f"file://{tmp_path}/store"
    tb.write_index(files, f"{path}/index", ["store"])
    tb.write_files(files, f"{path}/files", ["store"])
    files.select("store", "file_seq", F.lit(1).alias("x")).write.partitionBy("store", "file_seq").parquet(f"{path}/events")
    victims = fl.plan_purge(files, "binlog.000002", ["store"], check=False).filter("store = 'B'")
    assert tb.apply_purge(files, victims, path, ["store"]) == {"status": "success", "message": None}
    left = sorted((r.store, r.name) for r in tb.read_index(spark, f"{path}/index", ["store"]).collect())
    assert left == sorted((r.store, r.name) for r in files.collect() if not (r.store == "B" and r.file_seq < 3))
    assert spark.read.parquet(f"{path}/events").filter("store = 'B'").count() == 1 and tb.read_files(spark, f"{path}/files", keys=["store"]).filter("store = 'B'").count() == 1
