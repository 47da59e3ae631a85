"""Structured Streaming jobs that keep the event and file tables up to date, with whole transactions only."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import FRAMING, TXN_STARTS, is_file_end, is_txn_start
from ..operators.files import resume_after_ids
from ..operators.gtid import canonical, format_gtid_set, gtid_set_agg


def read_event_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New Parquet files of events as they appear; in steps of ``max_files``."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


#: Bytes of events (by their own size) and rows that the assembler holds or passes on at a time; a block of the file is the least it holds.
HELD_BYTES, HELD_ROWS = 8_000_000, 5_000
#: Positions of a file whose waiting events are one entry of the state.
BLOCK = 1 << 16


def _tuples(frame: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a frame, with None for what is missing."""
    columns = []
    for name in frame.columns:
        values = frame[name].tolist()
        columns.append([None if none else v for v, none in zip(values, frame[name].isna().tolist())] if frame[name].isna().any() else values)
    return zip(*columns)


class _Assembler(StatefulProcessor):
    """Emits the longest prefix of a file that ends at a boundary, in the order of the file, and waits for what is missing.  Framing without a position passes at once.

    An event follows the one that ends where it begins, so the order is the chain of positions and a hole is a place where no event begins.  State is the place up to which the chain is known,
    the open transaction, and the events that are not emitted yet, by blocks of ``BLOCK`` positions: a call to the state costs far more than an event, so a block is read and written whole.
    Events before the known place are repeats and are dropped.

    A transaction that passes its length, that is cut off by the next one or by the file's end, or an event outside any, is a fault: it is told as a row and the file stops there.
    """

    def __init__(self, schema: StructType):
        self.schema, self.names = schema, schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "emitted long, seen long, far long, declared long, run long, stopped boolean")
        self.waiting = handle.getMapState("waiting", "block long", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # ``far``: the farthest event that waits in the state
        emitted, seen, far, declared, run, stopped = self.place.get() if self.place.exists() else (4, 4, 0, None, 0, False)
        column = {n: i for i, n in enumerate(self.names)}
        size_at, next_at, kind_at, length_at = (column[n] for n in ("event_size", "next_pos", "type_name", "txn_length"))
        held, stored, changed = {}, set(), set()  # blocks at hand, each with its events by position; those that the state has; those that differ from it
        held_rows = held_bytes = 0
        out = []

        def block(start: int) -> dict:
            """The waiting events around a place.  Where too much is held, all other blocks go back first."""
            nonlocal held_rows, held_bytes
            n = start // BLOCK
            if n not in held:
                if held_rows > HELD_ROWS or held_bytes > HELD_BYTES:
                    put()
                held[n] = {}
                if emitted <= far and n <= far // BLOCK and self.waiting.containsKey((n,)):
                    held[n] = pickle.loads(self.waiting.getValue((n,))[0])
                    stored.add(n)
                    held_rows += len(held[n])
                    held_bytes += sum(int(r[size_at]) for r in held[n].values())
            return held[n]

        def take(start: int):
            """The waiting event that begins at a place, which goes."""
            nonlocal held_rows, held_bytes
            row = block(start).pop(start)
            changed.add(start // BLOCK)
            held_rows -= 1
            held_bytes -= int(row[size_at])
            return row

        def put():
            nonlocal far, held_rows, held_bytes
            for n in changed:
                if held[n]:
                    self.waiting.updateValue((n,), (pickle.dumps(held[n], 5),))
                    far = max(far, *held[n])
                elif n in stored:
                    self.waiting.removeKey((n,))
            for of in (held, stored, changed):
                of.clear()
            held_rows = held_bytes = 0

        def flush():
            nonlocal out
            columns = dict(zip(self.names, map(list, zip(*out))))
            frame = pd.DataFrame(columns | {"fault": None, "fault_at": None}, dtype=object)
            out = []
            return frame

        def fault(row, what: str):
            nonlocal stopped
            stopped = True
            blank = [None] * len(self.names)
            for c in ("file_seq", "file", "event_no", "event_size", "type_name"):
                if c in column:
                    blank[column[c]] = row[column[c]]
            return pd.DataFrame([(*blank, what, str(seen))], columns=[*self.names, "fault", "fault_at"], dtype=object)

        for frame in rows:
            fresh = []
            for row in _tuples(frame):
                if not row[next_at] and row[kind_at] in FRAMING and not stopped:
                    out.append(row)  # told without a place: it has no order to wait for
                    continue
                fresh.append((int(row[next_at] or 0) - int(row[size_at]), row))
            fresh.sort(key=lambda r: r[0])  # each block once
            for start, row in fresh:
                if start < seen or stopped or start in block(start):
                    continue  # a repeat
                block(start)[start] = row
                changed.add(start // BLOCK)
                held_rows += 1
                held_bytes += int(row[size_at])
            while not stopped and (row := block(seen).get(seen)) is not None:
                size, kind = int(row[size_at]), row[kind_at]
                framing, begins = kind in FRAMING, kind in TXN_STARTS
                whole = framing
                if declared is not None and (framing or begins):
                    yield fault(row, "F5 short")
                    break
                if begins:
                    declared, run = int(row[length_at] or 0), size
                elif not framing:
                    if declared is None:
                        yield fault(row, "F2 event before any transaction")
                        break
                    run += size
                if declared is not None:
                    if run > declared:
                        yield fault(row, "F5 exceeds")
                        break
                    whole = run == declared
                seen += size
                if whole:
                    declared, run = None, 0
                    while emitted < seen:
                        ready = take(emitted)
                        emitted += int(ready[size_at])
                        out.append(ready)
                        if len(out) >= HELD_ROWS:
                            yield flush()
        put()
        self.place.update((emitted, seen, far, declared, run, stopped))
        if out:
            yield flush()

    def close(self) -> None:
        pass


def assemble_transactions_stream(events: DataFrame, source: str = "file_seq") -> DataFrame:
    """Whole transactions and framing of each ``source`` (a file), in order and without holes; incomplete ones wait in the state store until their rest has come.

    Rows with ``fault`` are no events: they tell the rule that a file breaks, at ``fault_at``, after which nothing more of it is emitted.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    # whole numbers that may be missing pass as text: pandas would turn them into floats, which do not hold all of them
    loose = [f.name for f in events.schema if f.dataType.typeName() in ("long", "integer") and f.name not in ("event_no", "event_size", "next_pos", source)]
    rows = events.withColumns({c: F.col(c).cast("string") for c in loose})
    told = StructType([*rows.schema.fields, StructField("fault", StringType()), StructField("fault_at", StringType())])
    whole = rows.groupBy(source).transformWithStateInPandas(statefulProcessor=_Assembler(rows.schema), outputStructType=told, outputMode="Append", timeMode="None")
    return whole.select(*[F.col(f.name).cast(f.dataType) if f.name in loose else F.col(f.name) for f in events.schema], "fault", F.col("fault_at").cast("long").alias("fault_at"))


class _Connections(StatefulProcessor):
    """Follows each log's open file over reconnects: what an artificial rotate means for it, and when it was left open for too long."""

    def __init__(self, mode: str, idle_seconds: int):
        self.mode, self.idle = mode, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "file string, position long")

    def _tell(self, key, file, status: str, position) -> pd.DataFrame:
        return pd.DataFrame({"log": [str(key[0])], "file": [file], "status": [status], "position": [position]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")  # rotates and a figure for each file: a few rows
        file, position = self.open.get() if self.open.exists() else (None, 4)
        for r in frame.itertuples(index=False):
            if r.kind == "rotate":
                if file is None:
                    status = "created"
                elif file != r.file:
                    status = "switched"
                else:
                    status = "position differs" if self.mode == "position" and int(r.position) != position else "reused"
                if status in ("created", "switched"):
                    position = 4
                file = r.file
                yield self._tell(key, file, status, position)
            elif r.kind == "end":
                yield self._tell(key, r.file, "closed", int(r.position))
                file = None
            else:
                file, position = r.file, max(position, int(r.position))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if file is None:
            self.open.clear()
        else:
            self.open.update((file, position))
            if self.idle:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            file, position = self.open.get()
            self.open.clear()
            yield self._tell(key, file, "left open", position)

    def close(self) -> None:
        pass


def connection_stream(events: DataFrame, log: str = "log", mode: str = "gtid", idle_seconds: int = 0) -> DataFrame:
    """``log, file, status, position`` for every turn of a log's open file: ``created``, ``reused``, ``switched`` and ``position differs`` at artificial rotates, ``closed`` at a file's end, and ``left open``
    for a file that was told nothing of for ``idle_seconds`` (0: never).  Idle time needs a trigger by interval: while timers may come, a query that only drains its source does not end.

    ``events``: ``log, ord, file, type_name, artificial, next_pos, boundary`` and ``position``, that which a rotate tells.  Only rotates, ends and boundaries reach the state.
    """
    rotate = F.col("artificial") & (F.col("type_name") == "rotate")
    kind = F.when(rotate, "rotate").when(is_file_end(F.col("type_name"), F.col("artificial")), "end").when(F.col("boundary"), "grown")
    rows = events.select(F.col(log).cast("string").alias("log"), "ord", "file", kind.alias("kind"), F.coalesce(F.when(rotate, F.col("position")).otherwise(F.col("next_pos")), F.lit(0)).cast("long").alias("position")).filter("kind is not null")
    return rows.groupBy("log").transformWithStateInPandas(statefulProcessor=_Connections(mode, idle_seconds), outputStructType="log string, file string, status string, position long", outputMode="Append", timeMode="ProcessingTime" if idle_seconds else "None")


#: Batches between two snapshots of the live catalogue.
COMPACT = 8


def _write_batch(batch: DataFrame, path: str, number: int) -> None:
    """A batch's events, partial summaries of its files, the ids they added and the faults, under the batch's number."""
    write = lambda df, kind: df.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
    events = batch.filter("fault is null").drop("fault", "fault_at")
    write(events, "events")
    write(batch.filter("fault is not null").select(F.split("fault", " ", 2)[0].alias("rule"), "file_seq", F.col("fault_at").alias("position"), F.split("fault", " ", 2)[1].alias("detail")), "faults")
    ts = F.nullif(F.col("ts"), F.timestamp_seconds(F.lit(0)))
    starts = is_txn_start(F.col("type_name"))
    last = F.max(F.when(starts, F.struct("event_no", "sequence_number")))
    write(events.groupBy("file_seq", "file").agg(F.sum("event_size").cast("long").alias("bytes"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), last.alias("last")), "files")
    write(gtid_set_agg(events.filter(starts).select("file_seq", "uuid", "tag", "gno"), ["file_seq"]), "added")


def _merged_files(parts: DataFrame) -> DataFrame:
    return parts.groupBy("file_seq", "file").agg(F.sum("bytes").cast("long").alias("bytes"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.max("last").alias("last"))


def _compact(spark: SparkSession, path: str, number: int) -> None:
    """A snapshot of the catalogue as of a batch, from the snapshot before and the batches since; older ones go, but the last for readers that have begun."""
    for kind, merge in (("files", _merged_files), ("added", lambda rows: canonical(rows, ["file_seq"]))):
        merge(_parts(spark, path, kind, number)).write.mode("overwrite").parquet(f"{path}/{kind}/snapshot={number}")
        jvm, fs, root = _folder(spark, f"{path}/{kind}")
        whole = sorted(n for name, n in _numbered(fs, root, jvm) if name == "snapshot" and n <= number)
        for name, n in _numbered(fs, root, jvm):
            if len(whole) > 1 and n < whole[-2] or name == "batch" and len(whole) > 1 and n <= whole[-2]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}={n}"), True)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _numbered(fs, root, jvm) -> list[tuple[str, int]]:
    """``batch`` and ``snapshot`` folders that are whole, with their numbers."""
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):  # a snapshot or two and a few batches
        name, _, number = status.getPath().getName().partition("=")
        if number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((name, int(number)))
    return sorted(found)


def _parts(spark: SparkSession, path: str, kind: str, below: int | None = None) -> DataFrame:
    """The newest snapshot (older than batch ``below``, if given) and the batches after it."""
    jvm, fs, root = _folder(spark, f"{path}/{kind}")
    found = [(name, n) for name, n in _numbered(fs, root, jvm) if below is None or n < below or (name, n) == ("batch", below)]
    newest = max((n for name, n in found if name == "snapshot"), default=-1)
    chosen = [f"{path}/{kind}/{name}={n}" for name, n in found if n > newest and name == "batch" or (name, n) == ("snapshot", newest)]
    return spark.read.parquet(*chosen)


def live_added(spark: SparkSession, path: str) -> DataFrame:
    """``file_seq, uuid, tag, lo, hi``: the ids of each file as of now.  Reads one snapshot and at most ``COMPACT`` batches."""
    return canonical(_parts(spark, path, "added"), ["file_seq"])


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as of now, with each file's ids as text: one snapshot and the batches since, whose sums it adds."""
    last = F.coalesce(F.col("last.sequence_number"), F.lit(0).cast("long"))
    sums = _merged_files(_parts(spark, path, "files")).select("file_seq", F.col("file").alias("name"), (F.lit(4) + F.col("bytes")).cast("long").alias("size"), "min_ts", "max_ts", last.alias("last_sequence_number"))
    added = format_gtid_set(live_added(spark, path), ["file_seq"], "added_gtids")
    return sums.join(added, "file_seq", "left").select("file_seq", "name", "size", "added_gtids", "min_ts", "max_ts", "last_sequence_number")


def ingest(events: DataFrame, path: str, checkpoint: str, trigger: str = "once", have: DataFrame | None = None, compact: int = COMPACT) -> StreamingQuery:
    """Start a job that appends whole transactions and stored framing to ``path/events``, summaries of files to ``path/files``, ids to ``path/added`` and broken rules to ``path/faults``.

    Artificial events tell of the connection and are not stored.  ``have`` (``uuid, tag, lo, hi``) leaves out transactions that are held already, whole ones.

    ``trigger='once'`` drains what is there and stops; an interval such as ``'5 seconds'`` follows the source.  Each batch writes folders of its
    own number, so a batch that is run again after a failure replaces what it wrote before: nothing is lost or doubled.  Every ``compact`` batches the catalogue's
    parts become one snapshot.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            kept = batch if have is None else resume_after_ids(batch, have)
            _write_batch(kept, path, batch_id)
        finally:
            batch.unpersist()
        if batch_id and batch_id % compact == 0:
            _compact(batch.sparkSession, path, batch_id)

    if "artificial" in events.columns:
        events = events.filter(~F.col("artificial"))
    writer = assemble_transactions_stream(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if trigger == "once" else writer.trigger(processingTime=trigger)
    return writer.start()


def stream_faults(spark: SparkSession, path: str) -> DataFrame:
    """``rule, file_seq, position, detail`` of files that the stream has stopped at."""
    return spark.read.option("basePath", f"{path}/faults").parquet(f"{path}/faults").drop("batch")


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events").drop("batch")
