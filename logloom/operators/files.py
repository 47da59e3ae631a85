"""Log files: summaries built from events, and the questions a catalogue answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binlog_base, is_file_end, is_txn_start, parse_time
from ..session import cut
from .gtid import TSID, canonical, first_files, format_gtid_set, gtid_set_agg, gtid_subtract, gtid_union, overlap_join, parse_gtid_set, point_in_set_join
from .sequence import assign_transactions, drop_incomplete_tail


class CatalogueError(ValueError):
    """A question that the catalogue cannot answer; the text says why."""


def _ordered(keys: list[str] | None, *order: str):
    return Window.partitionBy(*(keys or [])).orderBy(*order)


def file_time_range(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First and last event time of each file; absent (epoch) times do not count, and a file with one end only has it twice."""
    ts = F.nullif(F.col("ts"), F.timestamp_seconds(F.lit(0)))
    out = events.groupBy(*(keys or []), "file_seq").agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    return out.select(*(keys or []), "file_seq", F.coalesce("min_ts", "max_ts").alias("min_ts"), F.coalesce("max_ts", "min_ts").alias("max_ts"))


def file_size(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """4 bytes of magic and the stored events up to the last boundary."""
    return drop_incomplete_tail(events, keys).groupBy(*(keys or []), "file_seq").agg((F.lit(4) + F.sum("event_size")).cast("long").alias("size"))


def _transactions(events: DataFrame, keys: list[str] | None) -> DataFrame:
    """One row for each transaction of a file, whole or not, and one for each framing row and what stands before the first transaction."""
    group = [*(keys or []), "file_seq"]
    ts = F.nullif(F.col("ts"), F.timestamp_seconds(F.lit(0)))
    first = F.min_by(F.struct("uuid", "tag", "gno", "sequence_number", "txn_length"), "event_no")
    named = assign_transactions(events, keys)
    alone = F.when(F.coalesce(F.col("txn_in_file"), F.lit(0)) == 0, F.col("event_no"))
    artificial = F.col("artificial") if "artificial" in events.columns else F.lit(False)
    sums = named.withColumn("_alone", alone).withColumn("_end", is_file_end(F.col("type_name"), artificial)).groupBy(*group, "txn_in_file", "_alone").agg(
        first.alias("t"), F.min("file").alias("name"), F.sum("event_size").alias("_size"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.max("event_no").alias("_last"), F.max("_end").alias("_end")
    )
    return sums.withColumn("whole", F.coalesce((F.col("txn_in_file") > 0) & (F.col("_size") == F.col("t.txn_length")), F.lit(False)))


def _completed(events: DataFrame, keys: list[str] | None) -> DataFrame:
    """One row for each completed transaction of a file."""
    return _transactions(events, keys).filter("whole").select(*(keys or []), "file_seq", "t.*", "_last")


def file_added_gtids(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``file_seq, uuid, tag, lo, hi`` of the transactions completed in each file."""
    return gtid_set_agg(_completed(events, keys).filter(F.col("gno") >= 1), [*(keys or []), "file_seq"])


def file_last_seq(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sequence number of the last completed transaction, 0 if there is none."""
    group = [*(keys or []), "file_seq"]
    done = F.max_by(F.col("t.sequence_number"), F.when(F.col("whole"), F.col("_last")))
    return _transactions(events, keys).groupBy(*group).agg(F.coalesce(done, F.lit(0).cast("long")).alias("last_sequence_number"))


def build_files(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The catalogue's row of each file, with its added set as text.

    Events become transactions in one pass; sizes, times, clocks and sets are sums over those.  What stands behind the last boundary of a file does not count.
    """
    group = [*(keys or []), "file_seq"]
    txns = _transactions(events, keys)
    last = F.max(F.when(F.col("whole") | F.col("_end"), F.col("_last"))).over(Window.partitionBy(*group))
    stored = txns.withColumn("_stored", last).filter(F.col("_last") <= F.col("_stored"))
    done = F.max_by(F.col("t.sequence_number"), F.when(F.col("whole"), F.col("_last")))
    sums = stored.groupBy(*group).agg(
        F.min("name").alias("name"), (F.lit(4) + F.sum("_size")).cast("long").alias("size"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.coalesce(done, F.lit(0).cast("long")).alias("last_sequence_number")
    )
    ids = txns.filter("whole").select(*group, "t.uuid", "t.tag", "t.gno").filter(F.col("gno") >= 1)
    added = format_gtid_set(gtid_set_agg(ids, group), group, "added_gtids")
    return sums.join(added, group, "left").select(*group, "name", "size", "added_gtids", "min_ts", "max_ts", "last_sequence_number")


# -- questions ---------------------------------------------------------------------------------------------------

def list_files(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return files.orderBy(*(keys or []), "file_seq")


def take_while(df: DataFrame, condition: Column, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows in order up to, and without, the first for which the condition does not hold."""
    stopped = F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(_ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_stopped", stopped).filter("_stopped = 0").drop("_stopped")


def _facts(files: DataFrame, keys: list[str] | None, stores: DataFrame | None, **facts: Column) -> DataFrame:
    """``keys`` and figures of each store's files, ``n`` their number.  ``stores`` names stores that may have no files; without keys there is always one row."""
    keys = keys or []
    got = files.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in facts.items()])
    if stores is not None and keys:
        got = stores.select(*keys).unionByName(files.select(*keys)).distinct().join(got, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got


def _told(facts: DataFrame, keys: list[str] | None, fault: Column) -> DataFrame:
    return facts.select(*(keys or []), fault.alias("message")).filter("message is not null")


def _refuse(faults: DataFrame, keys: list[str] | None) -> None:
    """Raise the first fault; with keys it names its store."""
    first = faults.orderBy(*(keys or []), "message").first()
    if first is not None:
        store = ", ".join(f"{k}={first[k]}" for k in keys or [])
        raise CatalogueError(f"{first.message} ({store})" if store else first.message)


def _good(files: DataFrame, faults: DataFrame, keys: list[str] | None) -> DataFrame:
    """The files of stores without a fault."""
    if keys:
        return files.join(F.broadcast(faults.select(*keys)), keys, "left_anti")  # a row for each refused store
    return files.join(faults.select(F.lit(1).alias("_one")), F.col("_one") == 1, "left_anti")


def _time(t: str) -> Column:
    return F.to_timestamp(F.lit(t), "yyyy-MM-dd'T'HH:mm:ss")


def timestamp_faults(files: DataFrame, t: str, keys: list[str] | None = None, stores: DataFrame | None = None) -> DataFrame:
    """``keys, message`` of each store that cannot answer: it is empty, or its first file begins after ``t``."""
    first = F.min_by(F.coalesce("min_ts", F.timestamp_seconds(F.lit(0))), "file_seq")
    return _told(_facts(files, keys, stores, first=first), keys, F.when(F.col("n") == 0, "Binlog storage is empty").when(F.col("first") > _time(t), "Timestamp is too old"))


def search_by_timestamp(files: DataFrame, t: str, keys: list[str] | None = None, check: bool = True, stores: DataFrame | None = None) -> DataFrame:
    """Files up to the first that begins after ``t``: a prefix of the order, whatever later clocks say.  Absent times never stop the walk.

    A store that cannot answer (``timestamp_faults``) raises by its name; with ``check=False`` it has no rows.
    """
    if check:
        if files.sparkSession.range(1).select(parse_time(F.lit(t)).isNull()).first()[0]:
            raise CatalogueError("Invalid timestamp format")
        _refuse(timestamp_faults(files, t, keys, stores), keys)
    return take_while(files, F.coalesce("min_ts", F.timestamp_seconds(F.lit(0))) <= _time(t), ["file_seq"], keys)


def covering_files(wanted: DataFrame, added: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, file_seq`` of the files that a walk in order would take: those that are the first to hold some wanted number."""
    keys = keys or []
    own = [k for k in keys if k in wanted.columns]
    added = cut(added.select(*keys, "file_seq", *TSID, "lo", "hi"), "added")
    if own != keys:
        wanted = added.select(*keys).distinct().join(wanted, own or None, "inner" if own else "cross")  # each store is asked
    return first_files(cut(wanted.select(*keys, *TSID, "lo", "hi"), "wanted"), added, keys)


def gtid_intersect_by_file(wanted: DataFrame, added: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What each file adds of the wanted set: clipped intervals with their file.  ``wanted`` has the keys too if it differs between them."""
    keys = keys or []
    own = [k for k in keys if k in wanted.columns]
    hit = overlap_join(added.select(*keys, "file_seq", *TSID, "lo", "hi"), canonical(wanted, own), keys=own)
    return hit.select(*keys, "file_seq", *TSID, F.greatest("lo", "b_lo").alias("lo"), F.least("hi", "b_hi").alias("hi"))


def gtid_faults_of_stores(files: DataFrame, added: DataFrame, wanted: DataFrame, mode: str = "gtid", keys: list[str] | None = None, stores: DataFrame | None = None) -> DataFrame:
    """``keys, message`` of each store that cannot answer, the first that holds: it is empty, its mode is another, or some wanted id is in none of its files."""
    keys = keys or []
    own = [k for k in keys if k in wanted.columns]
    named = files.select(*keys) if stores is None else files.select(*keys).unionByName(stores.select(*keys))
    asked = wanted if own == keys else named.distinct().join(F.broadcast(wanted), own or None, "inner" if own else "cross")  # a question is a few intervals
    short = gtid_subtract(asked, added.select(*keys, *TSID, "lo", "hi"), keys).groupBy(*keys).agg(F.count("*").alias("_short"))
    facts = _facts(files, keys, stores)
    facts = facts.join(short, keys, "left") if keys else facts.join(F.broadcast(short))  # without keys either has one row
    refused = "GTID set search is not supported in storages created in position-based replication mode"
    fault = F.when(F.col("n") == 0, "Binlog storage is empty").when(F.lit(mode != "gtid"), refused).when(F.col("_short") > 0, "The specified GTID set cannot be covered")
    return _told(facts, keys, fault)


def search_by_gtid_set(files: DataFrame, added: DataFrame, wanted: DataFrame | str, check: bool = True, keys: list[str] | None = None, mode: str = "gtid", stores: DataFrame | None = None) -> DataFrame:
    """The files, in order, that a walk takes until all wanted ids are found.  ``added``: ``keys, file_seq, uuid, tag, lo, hi``.

    ``mode`` is the stores' replication mode.  A set that is none raises; so does, by its name, a store that cannot answer (``gtid_faults_of_stores``); with ``check=False`` such a store gives the files
    that hold some of the set.
    """
    spark, keys = files.sparkSession, keys or []
    added = cut(added.select(*keys, "file_seq", *TSID, "lo", "hi"), "added")  # read for the check, for the sizes of blocks and for the join
    if isinstance(wanted, str):
        try:
            wanted = _parsed(spark, wanted)
        except Exception as e:
            if "cannot parse GTID set" not in str(e):
                raise
            raise CatalogueError("cannot parse GTID set") from e
    if check:
        _refuse(gtid_faults_of_stores(files, added, wanted, mode, keys, stores), keys)
    return files.join(covering_files(wanted, added, keys), [*keys, "file_seq"], "left_semi").orderBy(*keys, "file_seq")


def _parsed(spark, text: str) -> DataFrame:
    rows = parse_gtid_set(spark.createDataFrame([(text,)], "text string"), "text", []).collect()  # the question itself, a few intervals
    return spark.createDataFrame([tuple(r) for r in rows], "uuid string, tag string, lo long, hi long")


def purge_faults(files: DataFrame, target: str, keys: list[str] | None = None, stores: DataFrame | None = None) -> DataFrame:
    """``keys, message`` of each store that must not be purged up to ``target``: it is empty, has another base name or no such file, or that file is its last."""
    name = F.col("name")
    facts = _facts(files, keys, stores, base=F.min_by(binlog_base(name), "file_seq"), last=F.max_by("name", "file_seq"), there=F.bool_or(name == target))
    fault = F.when(F.col("n") == 0, "Binlog storage is empty").when(F.col("base") != target.rsplit(".", 1)[0], "base name differs").when(~F.col("there"), "no such file").when(F.col("last") == target, "cannot purge the last file")
    return _told(facts, keys, fault)


def plan_purge(files: DataFrame, target: str, keys: list[str] | None = None, check: bool = True, stores: DataFrame | None = None) -> DataFrame:
    """The files up to and with ``target``, store by store; never the last one of any.

    A store that must not be purged (``purge_faults``) raises by its name; with ``check=False`` nothing of it is planned.
    """
    faults = purge_faults(files, target, keys, stores)
    if check:
        _refuse(faults, keys)
    upto = F.max(F.when(F.col("name") == target, F.col("file_seq"))).over(Window.partitionBy(*(keys or [])))  # a row for each file
    return _good(files, faults, keys).withColumn("_upto", upto).filter(F.col("file_seq") <= F.col("_upto")).drop("_upto")


def latest_file(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    columns = [c for c in files.columns if c not in (keys or [])]
    return files.groupBy(*(keys or [])).agg(F.max_by(F.struct(*columns), "file_seq").alias("_f")).select(*(keys or []), "_f.*")


def resume_point(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Position mode: the last file and its size."""
    return latest_file(files, keys).select(*(keys or []), "name", F.col("size").alias("position"))


def resume_gtids(added: DataFrame, purged: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Id mode: all ids before the last file and in it, with the purged ones."""
    return canonical(added, keys) if purged is None else gtid_union(added, purged, keys)


def resume_after_ids(events: DataFrame, have: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a source sends to one that has the ids ``have`` (``uuid, tag, lo, hi``, with the keys if stores have different ones): whole transactions that it lacks, with all framing.

    Each transaction is judged by its first event's id, whatever gaps the set has; those without an id are always sent, and so is what stands before a file's first transaction.
    Works on a table, and on the batches of a stream with ``have`` as a fixed side.
    """
    keys = keys or []
    own = [k for k in keys if k in have.columns]
    named = assign_transactions(events, keys)
    starts = named.filter(is_txn_start(F.col("type_name")) & F.col("gno").isNotNull()).select(*keys, "file_seq", "txn_in_file", *TSID, "gno")
    held = point_in_set_join(starts, canonical(have, own), own).select(*keys, "file_seq", "txn_in_file")
    return named.join(held, [*keys, "file_seq", "txn_in_file"], "left_anti").select(*events.columns)


def file_added_text(added: DataFrame) -> DataFrame:
    return format_gtid_set(added, ["file_seq"], "added_gtids")
