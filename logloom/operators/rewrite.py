"""Rewriting a log: transactions packed into files of a bounded size, clocks renumbered, positions moved.

The order of a whole log is never put into one task: prefix sums are taken within source files and then over the files' totals,
and the chain of file starts is followed by pointer doubling on rows of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import output_name, varlen_size
from ..session import cut, cut_counted
from .gtid import BUCKET

MAGIC, LEAST = 4, 1024


def prefix_sums(txns: DataFrame, size: str = "size", out: str = "before", keys: list[str] | None = None) -> DataFrame:
    """Adds the total of all transactions before each one, in (``file_seq``, ``txn_no``) order, in two levels."""
    return _prefixes(txns, {out: size}, keys or [])


def _prefixes(rows: DataFrame, sums: dict[str, str], keys: list[str]) -> DataFrame:
    """Adds, for each new name, the sum of a column over all rows of smaller (``file_seq``, ``txn_no``): one window over files, one over their totals."""
    inside = Window.partitionBy(*keys, "file_seq").orderBy("txn_no").rangeBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source file
    totals = rows.groupBy(*keys, "file_seq").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    base = totals.select(*keys, "file_seq", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    both = own.join(base, [*keys, "file_seq"])
    return both.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in sums}).drop(*[f"_{x}_{n}" for n in sums for x in "ib"])


def _neighbours(ids: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_below`` and ``_above``: where the ids one lower and one higher stand (``_at``), if they are there.

    Numbers are sorted in cells, so one dominant uuid is many tasks; the first and last number of a cell are also shown to the cell beside it.
    """
    cell = ids.withColumn("_cell", F.expr(f"gno div {BUCKET}")).withColumn("_ghost", F.lit(False))
    last = cell.filter(F.col("gno") % BUCKET == BUCKET - 1).withColumns({"_cell": F.col("_cell") + 1, "_ghost": F.lit(True)})
    first = cell.filter(F.col("gno") % BUCKET == 0).withColumns({"_cell": F.col("_cell") - 1, "_ghost": F.lit(True)})
    w = Window.partitionBy(*keys, "uuid", "tag", "_cell").orderBy("gno")
    beside = lambda f, step: F.when(f("gno").over(w) == F.col("gno") + step, f("_at").over(w))
    rows = cell.unionByName(last).unionByName(first).withColumns({"_below": beside(F.lag, -1), "_above": beside(F.lead, 1)})
    return rows.filter(~F.col("_ghost")).drop("_cell", "_ghost")


def previous_sizes(txns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``previous_size``: bytes of the binary set of all ids before each transaction (``uuid, tag, gno``; none without ``gno``).

    A new id adds an interval unless its neighbours are there; a new uuid and tag adds a head, and tags are stored once any set has one.  So the size is a
    sum over what the transactions before have changed; changes and transactions go through one window together.
    """
    keys = keys or []
    ids = txns.filter(F.col("gno") >= 1).groupBy(*keys, "uuid", "tag", "gno").agg(F.min(F.struct("file_seq", "txn_no")).alias("_at"))
    earlier = lambda c: F.coalesce((F.col(c) < F.col("_at")).cast("long"), F.lit(0))
    none = F.lit(0).cast("long")
    place = [*keys, F.col("_at.file_seq").alias("file_seq"), F.col("_at.txn_no").alias("txn_no")]
    changed = _neighbours(ids, keys).select(*place, (16 * (1 - earlier("_below") - earlier("_above"))).cast("long").alias("_fixed"), none.alias("_tag"), none.alias("_tagged"))
    heads = ids.groupBy(*keys, "uuid", "tag").agg(F.min("_at").alias("_at")).select(*place, F.lit(24).cast("long").alias("_fixed"), (1 + F.length("tag")).cast("long").alias("_tag"), (F.col("tag") != "").cast("long").alias("_tagged"))
    rows = txns.select(*keys, "file_seq", "txn_no", none.alias("_fixed"), none.alias("_tag"), none.alias("_tagged"), F.struct(*txns.columns).alias("_row"))
    changes = changed.unionByName(heads).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    summed = _prefixes(rows.unionByName(changes), {"_f": "_fixed", "_t": "_tag", "_n": "_tagged"}, keys).filter("_row is not null")
    size = F.lit(8) + F.col("_f") + F.when(F.col("_n") > 0, F.col("_t")).otherwise(0)
    return summed.select("_row.*", size.cast("long").alias("previous_size"))


def file_heads(txns: DataFrame, fde_size: int = 122, keys: list[str] | None = None) -> DataFrame:
    """Adds ``previous_size`` and ``head``: the bytes before a file's first transaction, if the file begins with this one."""
    return previous_sizes(txns, keys).withColumn("head", (F.lit(MAGIC + fde_size + 19 + 4) + F.col("previous_size")).cast("long"))


def next_cut(rows: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """``keys, before, next``: for a file that begins at ``before`` with ``head`` bytes, the first later beginning at or past the limit.

    Beginnings and thresholds are sorted together in cells of one limit; a threshold past its cell's last beginning takes the first beginning of
    the next cell that has one.
    """
    points = rows.groupBy(*keys, "before").agg(F.min("head").alias("head"))
    points = points.withColumn("reach", F.greatest(F.col("before") + 1, F.col("before") + limit - F.col("head")))
    cell = lambda c: F.floor(c / limit)
    firsts = points.groupBy(*keys, cell(F.col("before")).alias("cell")).agg(F.min("before").alias("first"))
    all_cells = points.select(*keys, cell(F.col("reach")).alias("cell")).distinct().join(firsts, [*keys, "cell"], "full_outer")
    after = F.min("first").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(1, Window.unboundedFollowing))  # a row for each output file at most
    later = all_cells.select(*keys, "cell", after.alias("later"))
    both = points.select(*keys, F.col("before").alias("v"), F.lit(1).alias("kind"), F.col("before").alias("b")).unionByName(points.select(*keys, F.col("reach").alias("v"), F.lit(0).alias("kind"), F.col("before").alias("b")))
    w = Window.partitionBy(*keys, "cell").orderBy("v", "kind").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("cell", cell(F.col("v"))).withColumn("hit", F.min(F.when(F.col("kind") == 1, F.col("b"))).over(w)).filter("kind = 0")
    return found.join(later, [*keys, "cell"], "left").select(*keys, F.col("b").alias("before"), F.coalesce("hit", "later").alias("next"))


def _reached(start: DataFrame, jump: DataFrame, keys: list[str]) -> DataFrame:
    """All beginnings that jumps reach from the first ones: of those known so far what one, two and three jumps reach, then with jumps four times as far."""
    on = [*keys, "before"]
    far = lambda rows, jumps: rows.join(jumps, on).select(*keys, F.col("next").alias("before")).filter("before is not null")
    twice = lambda j: j.select(*keys, F.col("before").alias("_from"), F.col("next").alias("before")).join(j, on).select(*keys, F.col("_from").alias("before"), "next").filter("next is not null")
    jump, cuts, known = jump.filter("next is not null"), start, -1
    while True:
        one = far(cuts, jump)
        two = far(one, jump)
        cuts, count = cut_counted(cuts.unionByName(one).unionByName(two).unionByName(far(two, jump)).distinct(), "cuts")
        if count == known or far(far(far(start, jump), jump), jump).isEmpty():  # three jumps of all starts lead past the end, so four do: longer ones are not made
            return cuts
        known = count
        jump = cut(twice(twice(jump)), "jump")


def _filled(marks: DataFrame, numbered: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, before, out_file``: for every beginning the last numbered one at or before it, in two levels over cells of the log."""
    rows = marks.join(numbered, [*keys, "before"], "left").withColumn("cell", F.floor(F.col("before") / width))
    w = Window.partitionBy(*keys, "cell").orderBy("before").rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(*keys, "cell").agg(F.max("out_file").alias("top"))
    carried = tops.select(*keys, "cell", F.max("top").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return rows.withColumn("mine", F.max("out_file").over(w)).join(carried, [*keys, "cell"]).select(*keys, "before", F.coalesce("mine", "carried").alias("out_file"))


def pack_transactions(txns: DataFrame, file_size: int, head: int = MAGIC, open_size: int | None = None, base: str = "binlog", keys: list[str] | None = None) -> DataFrame:
    """Adds ``before``, ``out_file`` and ``out_name``: a new file begins before the first transaction that would begin at or past ``file_size``.

    ``txns``: ``keys, file_seq, txn_no, size``.  A column ``head`` (see ``file_heads``) has the bytes before the first transaction of a file that begins there, else they
    are ``head``; ``open_size`` is the current size of the file that is resumed.  No transaction is split, so a file may pass the size by one transaction.
    """
    if file_size < LEAST:
        raise ValueError(f"a file has at least {LEAST} bytes")
    keys = keys or []
    rows = cut(prefix_sums(txns if "head" in txns.columns else txns.withColumn("head", F.lit(head).cast("long")), keys=keys), "prefix")
    first = rows.groupBy(*keys).agg(F.min("before").alias("before")).filter("before is not null")
    start = first if open_size is None else rows.filter(F.col("before") >= max(0, file_size - open_size)).groupBy(*keys).agg(F.min("before").alias("before")).filter("before is not null")
    cuts = _reached(start, cut(next_cut(rows, file_size, keys), "jump"), keys)
    if open_size is not None:  # the first file has less room
        cuts = cuts.unionByName(first).distinct()
    numbered = cuts.withColumn("out_file", F.row_number().over(Window.partitionBy(*keys).orderBy("before")).cast("long"))  # a row for each output file
    filled = _filled(rows.select(*keys, "before").distinct(), numbered, keys, 64 * file_size)
    out = rows.join(filled, [*keys, "before"]).withColumn("out_name", output_name(F.lit(base), F.col("out_file")))
    return out if "head" in txns.columns else out.drop("head")


def renumber(txns: DataFrame, resume_offset: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Adds ``new_sequence_number`` 1, 2, 3, ... in each output file and ``new_last_committed`` as far behind it as before, within the file."""
    w = Window.partitionBy(*(keys or []), "out_file").orderBy("file_seq", "txn_no")
    sn = F.row_number().over(w).cast("long") + F.when(F.col("out_file") == 1, resume_offset).otherwise(0)
    rows = txns.withColumn("new_sequence_number", sn)
    delta = F.col("sequence_number") - F.col("last_committed")
    behind = F.col("new_sequence_number") - delta
    return rows.withColumn("new_last_committed", F.when(behind > 0, behind).when(F.col("new_sequence_number") == 1, 0).otherwise(1).cast("long"))


def normalize_checksum(events: DataFrame, mode: str = "add") -> DataFrame:
    """Adds ``new_size``: with four bytes of checksum more, less or as before (``add``, ``remove``, ``keep``)."""
    has = F.col("has_checksum")
    change = {"add": F.when(has, 0).otherwise(4), "remove": F.when(has, -4).otherwise(0), "keep": F.lit(0)}[mode]
    return events.withColumn("new_size", (F.col("event_size") + change).cast("long"))


def relocate(events: DataFrame, head: Column | int = MAGIC, size: str = "new_size", keys: list[str] | None = None) -> DataFrame:
    """Adds ``new_next_pos``: running size in the output file, behind ``head`` bytes (a column: that of the file's first row)."""
    w = Window.partitionBy(*(keys or []), "out_file").orderBy("file_seq", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.lit(head) if isinstance(head, int) else F.first(head).over(w)
    return events.withColumn("new_next_pos", (head + F.sum(size).over(w)).cast("long"))


def frame_files(packed: DataFrame, fde_size: int = 122, base: str = "binlog", keys: list[str] | None = None) -> DataFrame:
    """Rows ``keys, out_file, ord, type_name, event_size`` around the transactions: description and previous ids first, a rotate in all files but the last.

    ``packed`` has ``previous_size`` (see ``file_heads``); that of a file's first transaction counts, 8 (no ids) without the column.
    """
    keys = keys or []
    previous = F.min_by("previous_size", "before") if "previous_size" in packed.columns else F.lit(8)
    files = packed.groupBy(*keys, "out_file").agg(previous.cast("long").alias("_previous"))
    last = F.max("out_file").over(Window.partitionBy(*keys)).alias("_last")  # a row for each output file
    kind = "array<struct<ord:bigint,type_name:string,event_size:bigint>>"
    row = lambda ord, name, size: F.struct(F.lit(ord).cast("long").alias("ord"), F.lit(name).alias("type_name"), size.cast("long").alias("event_size"))
    front = F.array(row(-2, "format_description", F.lit(fde_size)), row(-1, "previous_gtids_log", F.lit(19 + 4) + F.col("_previous")))
    rotate = F.array(row(9_000_000_000, "rotate", F.lit(19 + 8 + 4) + F.length(output_name(F.lit(base), F.col("out_file") + 1))))
    framed = files.select("*", last).select(*keys, "out_file", F.explode(F.concat(front, F.when(F.col("out_file") < F.col("_last"), rotate).otherwise(F.array().cast(kind)))).alias("r"))
    return framed.select(*keys, "out_file", "r.*")


def tagged_size(fixed: Column, seq: Column, committed: Column, rest: Column) -> tuple[Column, Column]:
    """Size of a tagged id event and its transaction's length: each field's width depends on its value and the length on the event's own size.

    ``fixed``: bytes that do not change; ``rest``: bytes of the transaction's other events.  The length's width is the least that holds itself: one choice of nine, as a size
    put into the next one's expression would make it grow ninefold with each round.
    """
    own = fixed + varlen_size(2 * seq) + varlen_size(2 * committed)  # both are signed: a sign bit comes with them
    width = F.lit(9)
    for n in range(8, 0, -1):
        width = F.when(own + rest < F.lit((1 << (7 * n)) - n), n).otherwise(width)
    event = own + width
    return event, event + rest


def flush_points(txns: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Transactions after which completed data of their file is flushed: those that reach ``size`` bytes since the last flush, and each file's last.

    Flushes cut a file as files cut a log: the jumps from one flush to the next are followed by pointer doubling, all files at once.
    """
    group = [*(keys or []), "file_seq"]
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("txn_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = cut(txns.select(*group, "txn_no", "size", F.coalesce(before, F.lit(0)).cast("long").alias("before"), F.lit(0).cast("long").alias("head")), "prefix")
    start = rows.groupBy(*group).agg(F.min("before").alias("before"))
    cuts = _reached(start, cut(next_cut(rows, size, group), "jump"), group)
    # a flush comes behind the transaction before each cut, and behind the last one
    after = F.lead("before").over(Window.partitionBy(*group).orderBy("txn_no"))
    ends = rows.withColumn("_after", after)
    hit = ends.join(cuts.withColumnRenamed("before", "_after"), [*group, "_after"], "left_semi")
    return hit.unionByName(ends.filter("_after is null").select(*hit.columns)).select(*group, "txn_no", "size")


def _flushes(group: list[str], size: int | None, micros: int | None):
    """Rows sorted by file and number: those that flush, with the file's size after it and the cause."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, types, out = None, None, []
        total = ready = held = since = steady = last = None  # of the file at hand

        def close():
            if at is not None and ready > held:
                out.append((*at, last, MAGIC + ready, "close"))

        def drain():
            columns = list(zip(*out)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*group, "event_no", "position", "cause"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            types = types or [*[batch.schema.field(c).type for c in (*group, "event_no")], pa.int64(), pa.string()]
            names = [batch.column(c) for c in group]
            turns = np.zeros(n - 1, bool)
            for c in names:
                turns |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(turns) + 1).tolist(), n]
            sizes, ends = batch.column("event_size").to_numpy(), batch.column("boundary").to_numpy(zero_copy_only=False)
            times, numbers = batch.column("time"), batch.column("event_no")
            dated, times = pc.is_valid(times).to_numpy(zero_copy_only=False), pc.fill_null(times, 0).to_numpy()
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(c[a].as_py() for c in names)
                if key != at:
                    close()
                    at, total, ready, held, since, steady = key, 0, 0, 0, None, None
                sums = total + np.cumsum(sizes[a:b])
                whole = np.maximum(np.maximum.accumulate(np.where(ends[a:b], sums, 0)), ready)
                least = np.iinfo(np.int64).min if steady is None else steady
                clock = np.maximum(np.maximum.accumulate(np.where(dated[a:b], times[a:b], np.iinfo(np.int64).min)), least)
                total, steady = int(sums[-1]), None if clock[-1] == np.iinfo(np.int64).min else int(clock[-1])
                clock = np.where(clock == np.iinfo(np.int64).min, 0, clock)  # no time so far
                since, i = int(clock[0]) if since is None else since, 0
                while i < b - a:
                    full = late = b - a
                    if size is not None:
                        full = int(np.searchsorted(whole, held + max(size, 1)))
                    if micros is not None:
                        late = max(int(np.searchsorted(whole, held, "right")), int(np.searchsorted(clock, since + micros)))
                    i = max(i, min(full, late))
                    if i < b - a:
                        cause = "size" if size is not None and i >= full else "interval"
                        held, since = int(whole[i]), int(clock[i])
                        out.append((*at, numbers[a + i].as_py(), MAGIC + held, cause))
                        i += 1
                ready, last = int(whole[-1]), numbers[b - 1].as_py()
            if len(out) >= 10_000:
                yield drain()
        if types:
            close()
            yield drain()

    return run


def checkpoints(events: DataFrame, size: int | None = None, interval: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """When completed data of each file is flushed, by size or by elapsed time: ``keys, file_seq, event_no, position, cause``.

    ``events``: ``keys, file_seq, event_no, event_size, boundary`` (see ``mark_boundaries``) and ``arrived``, the time of arrival, which never goes back.  Ready is what ends at or before the last
    boundary.  An event flushes if something is ready and either ``size`` bytes of it have come since the last flush or ``interval`` seconds have gone by; a file's last event flushes what is
    left.  ``position`` is the file's size after the flush.

    A file's events pass in order, batch by batch, and only the figures of its last flush are kept between batches.  Both sums and times never fall, so the next flush is looked up in sorted columns.
    """
    if size is None and interval is None:
        raise ValueError("a size or an interval")
    group = [*(keys or []), "file_seq"]
    known = F.coalesce("boundary", F.lit(False)).alias("boundary")
    rows = events.select(*group, "event_no", F.coalesce("event_size", F.lit(0)).cast("long").alias("event_size"), known, F.unix_micros("arrived").alias("time"))
    schema = T.StructType([*[rows.schema[c] for c in (*group, "event_no")], T.StructField("position", T.LongType()), T.StructField("cause", T.StringType())])
    return rows.repartition(*group).sortWithinPartitions(*group, "event_no").mapInArrow(_flushes(group, size, None if interval is None else interval * 1_000_000), schema)
