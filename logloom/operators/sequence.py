"""Order within a log: positions, transactions, boundaries, cycles, and the rules they obey.

Windows are partitioned by file (with the store in front for a fleet), so they run side by side over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EVENT_TYPES, FRAMING, POST_HEADER_LENGTHS, is_file_end, is_txn_start, post_header_len

MAX_TXN = 2**32 - 1


def _in_file(keys: list[str] | None, order: str):
    return Window.partitionBy(*(keys or []), "file_seq").orderBy(order)


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def position_chain(events: DataFrame, keys: list[str] | None = None, order: str = "event_no") -> DataFrame:
    """Adds ``expected_start`` (the next_pos before, 4 at first) and ``chain_ok``."""
    w = _in_file(keys, order)
    rows = events.withColumn("expected_start", F.lag("next_pos", 1, 4).over(w))
    ok = (F.col("next_pos") != 0) & (F.col("expected_start") + F.col("event_size") == F.col("next_pos"))
    return rows.withColumn("chain_ok", ok)


def assign_transactions(events: DataFrame, keys: list[str] | None = None, order: str = "event_no") -> DataFrame:
    """Adds ``txn_in_file``: how many transactions have begun in the file; 0 before the first, NULL for framing."""
    begun = F.sum(is_txn_start(F.col("type_name")).cast("long")).over(_upto(_in_file(keys, order)))
    return events.withColumn("txn_in_file", F.when(~F.col("type_name").isin(*FRAMING), begun))


def mark_boundaries(events: DataFrame, keys: list[str] | None = None, order: str = "event_no") -> DataFrame:
    """Adds ``boundary``: the transaction has its declared length, or the event ends the file."""
    rows = assign_transactions(events, keys, order)
    w = Window.partitionBy(*(keys or []), "file_seq", "txn_in_file").orderBy(order)
    rows = rows.withColumn("_run", F.sum("event_size").over(_upto(w))).withColumn("_declared", F.first("txn_length").over(_upto(w)))
    artificial = F.col("artificial") if "artificial" in events.columns else F.lit(False)
    full = (F.col("txn_in_file") > 0) & (F.col("_run") == F.col("_declared"))
    return rows.withColumn("boundary", F.coalesce(full, F.lit(False)) | is_file_end(F.col("type_name"), artificial)).drop("_run", "_declared")


def assign_cycle(events: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds ``cycle``: how many artificial rotates so far, over files in two levels: within each file, then the files' totals before it."""
    keys, order = keys or [], order or ["ord"]
    mine = F.sum(F.col("artificial").cast("long")).over(Window.partitionBy(*keys, "file_seq").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = events.groupBy(*keys, "file_seq").agg(F.sum(F.col("artificial").cast("long")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("_mine", mine).join(totals.select(*keys, "file_seq", before.alias("_before")), [*keys, "file_seq"]).withColumn("cycle", F.col("_mine") + F.col("_before")).drop("_mine", "_before")


def drop_info_only(events: DataFrame, resume: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Without artificial rotates; on resume into a file that has events also without the first cycle's description and previous ids."""
    if resume:
        first = (F.col("cycle") == 1) & F.col("type_name").isin("format_description", "previous_gtids_log")
        return assign_cycle(events, keys).filter(~F.col("artificial") & ~first).drop("cycle")
    return events.filter(~F.col("artificial"))


def drop_framing(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("type_name").isin(*FRAMING))


def file_end_kind(events: DataFrame, keys: list[str] | None = None, order: str = "ord") -> DataFrame:
    """How each file ends: ``rotate``, ``stop``, or ``open``."""
    last = F.max_by(F.struct("type_name", "artificial"), order)
    kinds = events.groupBy(*(keys or []), "file_seq").agg(last.alias("_l"))
    end = F.when((F.col("_l.type_name") == "stop") | ((F.col("_l.type_name") == "rotate") & ~F.col("_l.artificial")), F.col("_l.type_name")).otherwise("open")
    return kinds.select(*(keys or []), "file_seq", end.alias("end_kind"))


def file_transitions(events: DataFrame, keys: list[str] | None = None, mode: str = "gtid") -> DataFrame:
    """For every artificial rotate, in order: the file is ``created`` first, ``reused`` if it is the one before, else ``switched``.

    ``mode='position'`` also holds the position that the rotate tells (column ``position``) against what is stored of a reused file, the end of its last boundary
    before the rotate: ``position differs``.
    """
    keys = keys or []
    rotate = F.col("artificial") & (F.col("type_name") == "rotate")
    rows = events
    if mode == "position":
        ended = F.when(F.col("boundary") & ~F.col("artificial"), F.col("next_pos"))
        rows = mark_boundaries(events, keys, "ord").withColumn("_stored", F.max(ended).over(_in_file(keys, "ord").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.lag("file").over(Window.partitionBy(*keys).orderBy("file_seq", "ord"))  # a row for each connection
    status = F.when(before.isNull(), "created").when(before != F.col("file"), "switched")
    if mode == "position":
        status = status.when(F.col("position") != F.coalesce("_stored", F.lit(4)), "position differs")
    return rows.filter(rotate).select(*keys, "file_seq", "file", status.otherwise("reused").alias("status"))


def drop_incomplete_tail(events: DataFrame, keys: list[str] | None = None, order: str = "event_no") -> DataFrame:
    """Only what is not behind the file's last boundary."""
    rows = mark_boundaries(events, keys, order)
    last = F.max(F.when(F.col("boundary"), F.col(order))).over(Window.partitionBy(*(keys or []), "file_seq"))
    return rows.withColumn("_last", last).filter(F.col(order) <= F.col("_last")).drop("_last")


def resume_filter(events: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events that the stored files (``file_seq, size``) do not hold yet: of the last file those from its size on, and later files."""
    keys = keys or []
    point = files.groupBy(*keys).agg(F.max_by(F.struct("file_seq", "size"), "file_seq").alias("_p"))
    one = F.lit(1).alias("_one")
    rows = events.select("*", one).join(F.broadcast(point.select("*", one)), [*keys, "_one"], "left").drop("_one")  # a row for each store
    new = F.col("_p").isNull() | (F.col("file_seq") > F.col("_p.file_seq")) | ((F.col("file_seq") == F.col("_p.file_seq")) & (F.col("start_pos") >= F.col("_p.size")))
    return rows.filter(new).drop("_p")


# -- rules -----------------------------------------------------------------------------------------------------------

def _row(rows: DataFrame, keys: list[str] | None, rule: str, position: Column, detail: Column) -> DataFrame:
    return rows.select(*(keys or []), F.lit(rule).alias("rule"), "file_seq", position.cast("long").alias("position"), detail.alias("detail"))


def broken_chain(events: DataFrame, keys: list[str] | None = None, order: str = "event_no") -> DataFrame:
    rows = position_chain(events, keys, order).filter(~F.col("chain_ok"))
    return _row(rows, keys, "F1", F.col("expected_start"), F.when(F.col("next_pos") == 0, "zero").otherwise("broken"))


def grammar_faults(events: DataFrame, keys: list[str] | None = None, order: str = "ord", previous_required: bool = True) -> DataFrame:
    """Rule F2 without a state machine: ranks and running counts over the stored events of each file."""
    rows = events.filter(~(F.col("artificial") & (F.col("type_name") == "rotate")))
    w = _in_file(keys, order)
    count = lambda c: F.sum(c.cast("long")).over(_upto(w))
    kind = F.col("type_name")
    rows = rows.select("*", F.row_number().over(w).alias("_n"), count(kind == "format_description").alias("_fde"), count(kind == "previous_gtids_log").alias("_prev"), count(is_txn_start(kind)).alias("_txn"), F.coalesce(F.sum(is_file_end(kind, F.col("artificial")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ended"))
    fault = (
        F.when(F.col("artificial"), "stray artificial event")
        .when((F.col("_n") == 1) & (kind != "format_description"), "no format description first")
        .when((kind == "format_description") & (F.col("_fde") > 1), "second format description")
        .when((kind == "previous_gtids_log") & (F.col("_prev") > 1), "second previous ids")
        .when((kind == "previous_gtids_log") & (F.col("_n") > 2), "late previous ids")
        .when(F.lit(previous_required) & (F.col("_n") == 2) & (kind != "previous_gtids_log"), "no previous ids second")
        .when(F.col("_ended") > 0, "event after the end")
        .when(~kind.isin(*FRAMING) & (F.col("_txn") == 0), "event before any transaction")
    )
    return _row(rows.withColumn("_fault", fault).filter(F.col("_fault").isNotNull()), keys, "F2", F.col(order), F.col("_fault"))


def rotate_faults(events: DataFrame, order: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """artificial rotates carry no time and no next position.  F4: the end of a file is not artificial."""
    head = events.filter(F.col("artificial") & (F.col("type_name") == "rotate") & (F.col("ts").isNotNull() | (F.col("next_pos") != 0)))
    tail = events.filter(F.col("artificial") & (F.col("type_name") == "stop"))
    return _row(head, keys, "F3", F.col(order), F.lit("time or position")).unionByName(_row(tail, keys, "F4", F.col(order), F.lit("artificial end")))


def rotate_position_faults(rotates: DataFrame, resume_file: str | None = None, resume_position: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """F3 and F4 on decoded rotates (``file_seq, artificial, next_file, position``): the position is 4, or that of the resumed file."""
    allowed = F.col("position") == 4
    if resume_file is not None:
        allowed = allowed | (F.col("artificial") & (F.col("next_file") == resume_file) & (F.col("position") == resume_position))
    rows = rotates.filter(~allowed)
    return rows.select(*(keys or []), F.when(F.col("artificial"), "F3").otherwise("F4").alias("rule"), "file_seq", "position", F.lit("position").alias("detail"))


def length_faults(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """a transaction's events add up to more or less than its declared length, or that passes 2^32-1."""
    group = [*(keys or []), "file_seq", "txn_in_file"]
    sums = assign_transactions(events, keys).filter("txn_in_file > 0").groupBy(*group).agg(F.sum("event_size").alias("_size"), F.min_by("txn_length", "event_no").alias("_declared"), F.min("start_pos").alias("_at"))
    fault = F.when(F.col("_declared") > MAX_TXN, "too long").when(F.col("_size") > F.col("_declared"), "exceeds").when(F.col("_size") < F.col("_declared"), "short")
    return _row(sums.withColumn("_fault", fault).filter(F.col("_fault").isNotNull()), keys, "F5", F.col("_at"), F.col("_fault"))


def gtid_faults(events: DataFrame, gtid_mode: bool = True, keys: list[str] | None = None) -> DataFrame:
    """anonymous in gtid mode; anonymous with an id; an id event without one."""
    kind, has = F.col("type_name"), F.col("gno").isNotNull() & (F.col("gno") >= 1)
    fault = F.when((kind == "anonymous_gtid_log") & F.lit(gtid_mode), "anonymous in gtid mode").when((kind == "anonymous_gtid_log") & has, "anonymous with an id").when(kind.isin("gtid_log", "gtid_tagged_log") & ~has, "no id")
    return _row(events.filter(is_txn_start(kind)).withColumn("_fault", fault).filter(F.col("_fault").isNotNull()), keys, "F6", F.col("start_pos"), F.col("_fault"))


def clock_faults(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """a transaction that claims to follow itself or a later one."""
    rows = events.filter(is_txn_start(F.col("type_name")) & (F.col("last_committed") >= F.col("sequence_number")))
    return _row(rows, keys, "F10", F.col("start_pos"), F.lit("clock"))


def checksum_faults(descriptions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """files (``file_seq, checksum_alg``) whose events have no checksum cannot be rewritten."""
    rows = descriptions.filter(F.coalesce(F.col("checksum_alg"), F.lit("off")) != "crc32")
    return _row(rows, keys, "F9", F.lit(4), F.lit("no checksum"))


def assert_checksums(descriptions: DataFrame) -> None:
    if not checksum_faults(descriptions).isEmpty():
        raise ValueError("rewriting needs checksums in every source file")


#: The rules that are judged from the order of a file's events.
RULES = ("F1", "F2", "F3", "F4", "F5", "F6", "F9", "F10")


def validate_log(events: DataFrame, rules: tuple[str, ...] = ("F1", "F5", "F6", "F10"), keys: list[str] | None = None, order: str = "event_no", previous_required: bool = True, gtid_mode: bool = True) -> DataFrame:
    """``keys, rule, file_seq, position, detail`` of all chosen rules; an ordered log has none.

    All rules are judged in one pass: events are dealt by file once, windows over that order give each event the faults that it shows, and those become rows.  F1, F5 and F6 are those of stored events,
    so artificial rotates are passed over; F9 looks at ``checksum_alg`` of descriptions (in ``fde`` or a column of its own).  Positions are those of the rules' own functions.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"no rules of a log's order: {sorted(unknown)}")
    keys, have = keys or [], set(events.columns)
    artificial = F.coalesce(F.col("artificial"), F.lit(False)) if "artificial" in have else F.lit(False)
    kind = F.col("type_name")
    rows = events.withColumns({"_art": artificial, "_skip": artificial & (kind == "rotate"), "_framing": kind.isin(*FRAMING), "_start": is_txn_start(kind)})
    file = Window.partitionBy(*keys, "file_seq", "_skip").orderBy(order)  # stored events of a file, its rotates apart
    count = lambda c: F.sum(c.cast("long")).over(_upto(file))
    start_pos = F.col("start_pos") if "start_pos" in have else F.col("next_pos") - F.col("event_size")
    rows = rows.withColumns({
        "_expected": F.lag("next_pos", 1, 4).over(file), "_n": F.row_number().over(file), "_fde": count(kind == "format_description"), "_prev": count(kind == "previous_gtids_log"), "_begun": count(F.col("_start")),
        "_ended": F.coalesce(F.sum(is_file_end(kind, F.col("_art")).cast("long")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_start_pos": start_pos,
    })
    txn = Window.partitionBy(*keys, "file_seq", "_skip", "_framing", "_begun").orderBy(order)
    whole = txn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_size": F.sum("event_size").over(whole), "_declared": F.first("txn_length").over(whole), "_first": F.row_number().over(txn) == 1})
    stored, at = ~F.col("_skip"), lambda c: c.cast("long")
    has = F.col("gno").isNotNull() & (F.col("gno") >= 1)
    checksum = F.col("fde.checksum_alg") if "fde" in have else F.col("checksum_alg") if "checksum_alg" in have else F.lit("crc32")
    grammar = (
        F.when(F.col("_art"), "stray artificial event")
        .when((F.col("_n") == 1) & (kind != "format_description"), "no format description first")
        .when((kind == "format_description") & (F.col("_fde") > 1), "second format description")
        .when((kind == "previous_gtids_log") & (F.col("_prev") > 1), "second previous ids")
        .when((kind == "previous_gtids_log") & (F.col("_n") > 2), "late previous ids")
        .when(F.lit(previous_required) & (F.col("_n") == 2) & (kind != "previous_gtids_log"), "no previous ids second")
        .when(F.col("_ended") > 0, "event after the end")
        .when(~F.col("_framing") & (F.col("_begun") == 0), "event before any transaction")
    )
    length = F.when(F.col("_declared") > MAX_TXN, "too long").when(F.col("_size") > F.col("_declared"), "exceeds").when(F.col("_size") < F.col("_declared"), "short")
    ids = F.when((kind == "anonymous_gtid_log") & F.lit(gtid_mode), "anonymous in gtid mode").when((kind == "anonymous_gtid_log") & has, "anonymous with an id").when(kind.isin("gtid_log", "gtid_tagged_log") & ~has, "no id")
    broken = (F.col("next_pos") == 0) | (F.col("_expected") + F.col("event_size") != F.col("next_pos"))
    found = {
        "F1": (F.when(stored & broken, F.when(F.col("next_pos") == 0, "zero").otherwise("broken")), F.col("_expected")),
        "F2": (F.when(stored, grammar), F.col(order)),
        "F3": (F.when(F.col("_skip") & (F.col("ts").isNotNull() | (F.col("next_pos") != 0)), "time or position"), F.col(order)),
        "F4": (F.when(F.col("_art") & (kind == "stop"), "artificial end"), F.col(order)),
        "F5": (F.when(stored & ~F.col("_framing") & (F.col("_begun") > 0) & F.col("_first"), length), F.col("_start_pos")),
        "F6": (F.when(F.col("_start"), ids), F.col("_start_pos")),
        "F9": (F.when((kind == "format_description") & (F.coalesce(checksum, F.lit("off")) != "crc32"), "no checksum"), F.lit(4)),
        "F10": (F.when(F.col("_start") & (F.col("last_committed") >= F.col("sequence_number")), "clock"), F.col("_start_pos")),
    }
    one = lambda r: F.when(found[r][0].isNotNull(), F.struct(F.lit(r).alias("rule"), at(found[r][1]).alias("position"), found[r][0].alias("detail")))
    faults = rows.select(*keys, "file_seq", F.explode(F.array_compact(F.array(*[one(r) for r in rules]))).alias("f"))
    return faults.select(*keys, "f.rule", "file_seq", "f.position", "f.detail")


def with_event_dims(events: DataFrame, code: str = "code", before_83: bool = True) -> DataFrame:
    """Adds ``type_name`` and ``post_header_len`` of each event code; unknown codes have none.  The dimension has a row for each of the format's codes."""
    spark = events.sparkSession
    lengths = dict(enumerate(POST_HEADER_LENGTHS, 1))
    dims = spark.createDataFrame(list(EVENT_TYPES.items()), f"{code} int, type_name string")
    if before_83:
        dims = dims.join(F.broadcast(spark.createDataFrame(list(lengths.items()), f"{code} int, post_header_len int")), code, "left")
    else:
        dims = dims.withColumn("post_header_len", post_header_len(F.lit(80300), F.col(code)))
    return events.join(F.broadcast(dims), code, "left")
