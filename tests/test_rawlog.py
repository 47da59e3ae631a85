"""Raw files in ranges and as a stream."""

import os
import random

import pytest

from logloom.operators import sequence as sq
from logloom.sources import binlog as bl
from logloom.sources import rawlog as raw
from logloom.sources.pack import Log, pack_transaction
from logloom.streaming import ingest as stream

U = "00010203-0405-0607-0809-0a0b0c0d0e0f"


def a_log(n, seed=1, crc=True, extra=True):
    g, log = random.Random(seed), Log(crc).description().previous()
    for i in range(1, n + 1):
        inner = Log(crc).description().data if extra and i % 5 == 0 else b""  # a transaction may hold bytes of another log
        pack_transaction(log, U, "t" if i % 7 == 0 else "", i, i - 1, i, [(2, 60 + g.randrange(500)), (30, 40 + g.randrange(3000))])
        if inner:
            log.event(29, bytes(inner))
    return log.rotate("b.000002")


@pytest.mark.parametrize("crc", [True, False])
def test_ranges_equal_one_range(spark, tmp_path, crc):
    data = a_log(60, crc=crc).data
    (tmp_path / "b.000001").write_bytes(data)
    columns = [c for c in bl.EVENTS.names if c != "event_no"]
    whole = bl.read_binlog(spark, str(tmp_path)).select(*columns).orderBy("start_pos").collect()
    for split in (len(data) + 9, -(-len(data) // 8), 700, 64):
        rows = raw.read_raw_log(spark, str(tmp_path), split)
        assert rows.select(*columns).orderBy("start_pos").collect() == whole
        assert rows.filter("event_no <> start_pos").count() == 0
    assert rows.rdd.getNumPartitions() >= len(data) // 64


@pytest.mark.parametrize("damage, message", [(lambda d: b"x" + d[1:], "not a log file"), (lambda d: d[:-3], "cut off"), (lambda d: d[:5000] + bytes(6000) + d[11000:], "b.000001 at")])
def test_damaged_ranges(spark, tmp_path, damage, message):
    (tmp_path / "b.000001").write_bytes(damage(bytes(a_log(40).data)))
    for split in (10**9, 3000):
        with pytest.raises(Exception, match=message):
            raw.read_raw_log(spark, str(tmp_path), split).select("payload").collect()


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """Sparse: events of 64 MB of zeros."""
    import zlib

    log, each = Log().description().previous(), 64 << 20
    with open(tmp_path / "b.000001", "wb") as f:
        f.write(log.drain())
        for _ in range(34):
            at = log.passed_on
            head = bytearray(Log().event(30, b"").data[4:23])
            head[9:13], head[13:17] = each.to_bytes(4, "little"), ((at + each) & 0xFFFFFFFF).to_bytes(4, "little")
            crc = zlib.crc32(bytes(each - 19 - 4), zlib.crc32(head))
            f.write(head)
            f.seek(each - 19 - 4, os.SEEK_CUR)
            f.write(crc.to_bytes(4, "little"))
            log.passed_on += each
    assert os.path.getsize(tmp_path / "b.000001") > 2**31
    rows = raw.read_raw_log(spark, str(tmp_path), 600 << 20, payloads=False)
    got = rows.select("type_name", "start_pos", "event_size", "crc_ok").orderBy("start_pos").collect()
    assert len(got) == 36 and all(r.crc_ok for r in got) and got[-1].start_pos + each == os.path.getsize(tmp_path / "b.000001")


def test_growing_files_and_a_restart_within_a_transaction(spark, tmp_path):
    data, source, out = bytes(a_log(25, extra=False).data), tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    path = source / "b.000001"

    def drain():
        events = bl.log_events(raw.raw_log_stream(spark, str(source), 5000)).drop("rotate", "fde", "previous_gtids", "commit_group_ticket", "immediate_commit_ts", "original_commit_ts")
        stream.ingest(events, out, f"{out}/checkpoint").awaitTermination()
        return stream.stored_events(spark, out)

    for end in (100, 9000, 9007, 20_011, len(data)):
        path.write_bytes(data[:end])  # bytes are cut anywhere, also within an event
        stored = drain()
        rows = stored.select("start_pos", "event_size").orderBy("start_pos").collect()
        assert all(a.start_pos + a.event_size == b.start_pos for a, b in zip(rows, rows[1:])) and (not rows or rows[-1].start_pos + rows[-1].event_size <= end)
    whole = bl.log_events(bl.read_binlog(spark, str(source)))
    assert sorted(map(tuple, stored.select("start_pos", "type_name", "gno").collect()), key=repr) == sorted(map(tuple, whole.select("start_pos", "type_name", "gno").collect()), key=repr)
    assert sq.validate_log(whole).count() == 0


def test_many_short_ranges_share_tasks(spark, tmp_path):
    """The number of tasks does not follow the number of files and ranges; every event is read once."""
    parts = [r for f in range(3000) for r in raw.ranges(f"/b.{f:06d}", f"b.{f:06d}", 4, 20_000, 20_000, 4000, True)]
    assert len(parts) == 15_000 and len(raw.packed(parts)) <= 2 * raw.TASKS
    assert [r for task in raw.packed(parts) for r in task.parts] == parts
    large = raw.ranges("/b.000001", "b.000001", 4, 1 << 40, 1 << 40, 128 << 20, True)
    assert len(raw.packed(large)) == len(large)
    for i in range(5):
        (tmp_path / f"b.{i + 1:06d}").write_bytes(a_log(20, seed=i).data)
    whole = bl.read_binlog(spark, str(tmp_path)).select("file", "start_pos", "event_size").orderBy("file", "start_pos").collect()
    reader = raw._BatchReader({"path": str(tmp_path), "split_bytes": "700"})
    tasks = raw.packed([r for task in reader.partitions() for r in task.parts], 4, 4)
    assert len(tasks) <= 8
    rows = [(r["file"], r["start_pos"], r["event_size"]) for task in tasks for batch in reader.read(task) for r in batch.to_pylist()]
    assert sorted(rows) == [tuple(r) for r in whole]
