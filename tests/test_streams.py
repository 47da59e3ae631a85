"""The state of streams, step by step, and what follows from it."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators import sequence as sq
from logloom.streaming import ingest as stream

SCHEMA = T.StructType([T.StructField(n, T.StringType() if n in ("type_name", "txn_length", "file") else T.LongType()) for n in ("file_seq", "file", "event_no", "type_name", "event_size", "next_pos", "txn_length")])


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d, self.reads = {}, 0

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        self.reads += 1
        return self.d[k]

    def removeKey(self, k):
        del self.d[k]

    def updateValue(self, k, v):
        self.d[k] = v


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, schema):
        return Map()


def a_file(txns, declared=None):
    rows, at, no = [], 4, 0
    for kind, sizes in txns:
        total = sum(sizes) if declared is None else declared
        for i, n in enumerate(sizes):
            at += n
            rows.append((1, "b.000001", no, kind if i == 0 else "xid", n, at, str(total) if i == 0 and kind == "gtid_log" else None))
            no += 1
    return rows


def run(batches):
    p = stream._Assembler(SCHEMA)
    p.init(Handle())
    for frames in batches:
        got = [tuple(r) for f in p.handleInputRows((1,), iter([pd.DataFrame(f, columns=SCHEMA.names) for f in frames]), None) for r in f.itertuples(index=False, name=None)]
        yield p, got


LOG = a_file([("format_description", [100]), ("previous_gtids_log", [50])] + [("gtid_log", [60, 20 + i, 30]) for i in range(40)] + [("gtid_log", [60] + [10] * 500)] + [("rotate", [40])])


@pytest.mark.parametrize("seed", range(6))
def test_any_order_gives_the_log_in_order(seed, monkeypatch):
    monkeypatch.setattr(stream, "HELD_ROWS", 7)
    g = random.Random(seed)
    rows = LOG + g.sample(LOG, 30)  # some come twice
    g.shuffle(rows) if seed % 2 else None
    batches, i = [], 0
    while i < len(rows):
        n = g.randrange(1, 90)
        part = rows[i : i + n]
        batches.append([part[: n // 2], part[n // 2 :]] if n // 2 and part[n // 2 :] else [part])
        i += n
    told = []
    for p, got in run(batches):
        told += got
        ends = [int(r[5]) for r in told]
        assert ends == sorted(ends) and len(set(ends)) == len(ends)
        assert [r[:7] for r in told] == LOG[: len(told)] or [tuple(map(str, r[:7])) for r in told] == [tuple(map(str, r)) for r in LOG[: len(told)]]
    assert len(told) == len(LOG) and not p.waiting.d and all(r[7] is None for r in told)


def test_nothing_passes_a_hole():
    hole = [r for r in LOG if r[2] != 8]
    steps = list(run([[hole], [[r for r in LOG if r[2] == 8]]]))
    assert [r[2] for r in steps[0][1]] == list(range(8)) and [r[2] for r in steps[1][1]] == list(range(8, len(LOG)))


def test_long_transactions_are_read_once():
    big = a_file([("gtid_log", [60] + [10] * 999)])
    p = None
    for p, got in run([[big[i : i + 50]] for i in range(0, 1000, 50)]):
        if len(p.waiting.d) and not got:
            continue
    assert len(got) == 1000 and p.waiting.reads <= 1000 + 2 * 20


@pytest.mark.parametrize("log, fault", [(a_file([("gtid_log", [60, 20])] * 3, declared=81), "F5 short"), (a_file([("gtid_log", [60, 20])] * 3, declared=79), "F5 exceeds"), (a_file([("format_description", [9]), ("query", [60])]), "F2 event before any transaction"), (a_file([("gtid_log", [60]), ("rotate", [20])], declared=61), "F5 short")])
def test_faults_stop_a_file(log, fault):
    steps = list(run([[log], [a_file([("gtid_log", [60, 20])])]]))
    assert [r[7] for r in steps[0][1] if r[7]] == [fault] and steps[1][1] == []


def test_connections(spark, tmp_path):
    schema = "log string, ord long, file string, type_name string, artificial boolean, next_pos long, boundary boolean, position long"
    rotate = lambda log, o, file, position=4: (log, o, file, "rotate", True, 0, False, position)
    grown = lambda log, o, file, at: (log, o, file, "xid", False, at, True, None)
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    batches = [
        [rotate("a", 1, "b.1"), grown("a", 2, "b.1", 500), rotate("b", 1, "b.1")],
        [rotate("a", 3, "b.1", 500), grown("a", 4, "b.1", 700), rotate("a", 5, "b.1", 600), rotate("a", 6, "b.2"), grown("b", 2, "b.1", 90)],
        [("a", 7, "b.2", "stop", False, 900, True, None), rotate("a", 8, "b.3")],
    ]
    columns = "log string, file string, status string, position long"
    told = lambda: [tuple(r) for r in spark.read.schema(columns).parquet(out).collect()]
    turns = lambda idle: stream.connection_stream(spark.readStream.schema(schema).json(str(source)), mode="position", idle_seconds=idle).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-c{idle}")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        turns(0).trigger(availableNow=True).start().awaitTermination()
    assert sorted(told()) == sorted([("a", "b.1", "created", 4), ("b", "b.1", "created", 4), ("a", "b.1", "reused", 500), ("a", "b.1", "position differs", 700), ("a", "b.2", "switched", 4), ("a", "b.2", "closed", 900), ("a", "b.3", "created", 4)])
    out = f"file://{tmp_path}/idle"
    query = turns(1).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 40
        while time.time() < until:
            query.awaitTermination(2)
            if any((tmp_path / "idle").glob("*.parquet")) and sum(r[2] == "left open" for r in told()) == 2:
                break
    finally:
        query.stop()
    assert {("a", "b.3", "left open", 4), ("b", "b.1", "left open", 90)} <= set(told())


def test_snapshots_bound_what_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/live"
    rows = [(1, "b.000001", i, "gtid_log" if i % 2 == 0 else "xid", 10, 14 + 10 * i, "u", "", i // 2 + 1, i // 2 + 1, None) for i in range(60)]
    schema = "file_seq long, file string, event_no long, type_name string, event_size long, next_pos long, uuid string, tag string, gno long, sequence_number long, fault string"
    df = spark.createDataFrame(rows, schema).withColumns({"ts": F.timestamp_seconds(F.col("event_no") + 5), "fault_at": F.lit(None).cast("long")})
    for n in range(10):
        stream._write_batch(df.filter(F.floor(F.col("event_no") / 6) == n), path, n)
        if n and n % 3 == 0:
            stream._compact(spark, path, n)
    assert [(r["size"], r.added_gtids, r.last_sequence_number) for r in stream.live_files(spark, path).collect()] == [(604, "u:1-30", 30)]
    left = sorted(p.name for p in (tmp_path / "live" / "files").iterdir())
    assert left == ["batch=7", "batch=8", "batch=9", "snapshot=6", "snapshot=9"]
    stream._compact(spark, path, 9)  # a batch that is run again
    assert stream.live_files(spark, path).first()["size"] == 604


def test_held_ids_are_left_out_of_a_stream(spark, tmp_path):
    rows = [(1, "b.000001", i, "gtid_log" if i % 2 == 0 else "xid", 10, 14 + 10 * i, "u", "", i // 2 + 1, i // 2 + 1, 20) for i in range(20)]
    schema = "file_seq long, file string, event_no long, type_name string, event_size long, next_pos long, uuid string, tag string, gno long, sequence_number long, txn_length long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("event_no"))
    df.write.parquet(f"file://{tmp_path}/in")
    have = spark.createDataFrame([("u", "", 2, 3), ("u", "", 7, 7)], "uuid string, tag string, lo long, hi long")
    events = stream.read_event_stream(spark, f"file://{tmp_path}/in", df.schema)
    stream.ingest(events, f"file://{tmp_path}/out", f"file://{tmp_path}/c", have=have).awaitTermination()
    got = stream.stored_events(spark, f"file://{tmp_path}/out")
    assert sorted({(r.event_no // 2) + 1 for r in got.collect()}) == [1, 4, 5, 6, 8, 9, 10] and got.count() == 14


def test_all_rules_share_one_exchange(spark):
    rows = spark.createDataFrame([(1, 1, "gtid_log", 10, 14, None, "u", "", 1, 1, 0, 10, False)], "file_seq long, event_no long, type_name string, event_size long, next_pos long, ts timestamp, uuid string, tag string, gno long, sequence_number long, last_committed long, txn_length long, artificial boolean")
    plan = sq.validate_log(rows, sq.RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        sq.validate_log(rows, ("F7",))


def test_waiting_events_are_read_and_written_in_blocks():
    """The state is called for blocks, not for events: 2000 events that wait and then go."""
    log = a_file([("gtid_log", [60, 20, 30, 40])] * 500)
    (p, none), (_, got) = run([[log[4:]], [log[:4]]])
    assert none == [] and [r[2] for r in got] == list(range(2000))
    assert 1 <= p.waiting.reads <= 1 + log[-1][5] // stream.BLOCK and not p.waiting.d


def test_a_block_with_repeats_and_a_hole_between_batches():
    log = a_file([("gtid_log", [60, 20, 30, 40])] * 5000)
    late = [r for r in log if r[2] % 1000 != 7]
    steps = list(run([[late[9000:], late[:9000]], [late[100:400]], [[r for r in log if r[2] % 1000 == 7]]]))
    assert [r[2] for _, got in steps for r in got] == list(range(20_000)) and not steps[-1][0].waiting.d
