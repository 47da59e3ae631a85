import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import files as fl
from logloom.operators import rewrite as rw
from logloom.operators import sequence as sq
from logloom.operators import store as st
from logloom.sources import tables as tb
from logloom.streaming import ingest as stream

EVENT = "file string, file_seq long, event_no long, type_name string, artificial boolean, uuid string, tag string, gno long, event_size long, start_pos long, next_pos long, txn_length long, sequence_number long, last_committed long, ts timestamp"


def log(files):
    """Rows of files given as lists of transactions, each a list of event sizes."""
    rows, gno, no = [], 0, 0
    for f, txns in enumerate(files, 1):
        at = 4
        for n, sizes in enumerate(txns, 1):
            gno += 1
            for i, s in enumerate(sizes):
                rows.append((f"b.{f:06d}", f, no, "gtid_log" if i == 0 else "query", False, "11111111-aaaa-1111-aaaa-111111111111", "", gno, s, at, at + s, sum(sizes), n, n - 1, datetime(2024, 1, 1, 0, 0, f)))
                at += s
                no += 1
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(log([[[70, 10, 20], [65, 30]], [[80, 5]], [[66, 1, 1, 1]]]), EVENT)


def test_clean_log(events):
    assert sq.validate_log(events).count() == 0
    assert events.count() == sq.drop_incomplete_tail(events).count()
    assert [r.txn_in_file for r in sq.assign_transactions(events).orderBy("event_no").collect()] == [1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1]


def test_tail_is_cut(events):
    short = events.filter("event_no <> 4")
    assert {r.event_no for r in sq.drop_incomplete_tail(short).collect()} == {0, 1, 2, 5, 6, 7, 8, 9, 10}
    files = {r.file_seq: r for r in fl.build_files(short).collect()}
    assert (files[1].size, files[1].last_sequence_number, files[1].added_gtids[-2:]) == (104, 1, ":1")
    assert sq.length_faults(short).first().detail == "short"


def test_catalogue(spark, events):
    files = fl.build_files(events)
    assert [r.name for r in fl.list_files(files).collect()] == ["b.000001", "b.000002", "b.000003"]
    assert fl.latest_file(files).first().file_seq == 3
    assert (p := fl.resume_point(files).first()) and (p.name, p.position) == ("b.000003", 73)
    assert fl.search_by_timestamp(files, "2024-01-01T00:00:02").count() == 2
    for t, message in (("20240101T000000", "Invalid timestamp format"), ("2000-01-01T00:00:00", "too old")):
        with pytest.raises(fl.CatalogueError, match=message):
            fl.search_by_timestamp(files, t)
    with pytest.raises(fl.CatalogueError, match="empty"):
        fl.search_by_timestamp(files.limit(0), "2024-01-01T00:00:00")
    back = files.withColumn("min_ts", F.when(F.col("file_seq") == 2, F.lit(datetime(2030, 1, 1))).otherwise(F.col("min_ts")))
    assert fl.search_by_timestamp(back, "2024-06-01T00:00:00").count() == 1  # the later file is behind the stop
    absent = files.withColumn("min_ts", F.when(F.col("file_seq") != 1, F.col("min_ts")))
    assert fl.search_by_timestamp(absent, "2024-06-01T00:00:00").count() == 3


@pytest.mark.parametrize("name, message", [("other.000001", "base name"), ("b.000009", "no such"), ("b.000003", "last file")])
def test_purge_guards(events, name, message):
    with pytest.raises(fl.CatalogueError, match=message):
        fl.plan_purge(fl.build_files(events), name)


def test_purge(spark, events, tmp_path):
    path = f"file://{tmp_path}/store"
    files = fl.build_files(events)
    tb.write_events(events, f"{path}/events")
    tb.write_files(files, f"{path}/files")
    victims = fl.plan_purge(files, "b.000002")
    assert tb.apply_purge(files, victims, path) == {"status": "success", "message": None}
    assert [r.name for r in tb.read_index(spark, f"{path}/index").collect()] == ["b.000003"]
    assert [r.name for r in tb.read_files(spark, f"{path}/files").collect()] == ["b.000003"]
    again = tb.apply_purge(files, victims, path)
    assert again["status"] == "warning" and "could not delete" in again["message"]


def test_metadata_versions(spark, tmp_path):
    (tmp_path / "name=b.000001").mkdir()
    (tmp_path / "name=b.000001" / "x.json").write_text('{"version": 2, "size": 5}\n')
    (tmp_path / "name=b.000002").mkdir()
    (tmp_path / "name=b.000002" / "x.json").write_text('{"version": 1, "size": 5, "min_timestamp": "2024-01-01T00:00:00"}\n')
    (tmp_path / "name=b.000003").mkdir()
    (tmp_path / "name=b.000003" / "x.json").write_text("{broken\n")
    assert [r.name for r in tb.read_files(spark, str(tmp_path), strict=False).collect()] == ["b.000002"]
    with pytest.raises(Exception, match="unsupported metadata"):
        tb.read_files(spark, str(tmp_path)).collect()


def test_audit(spark):
    index = spark.createDataFrame([("./b.000001", 0, "b.000001"), ("b.000002", 1, "b.000002"), ("./b.000001", 2, "b.000001"), ("./binlog.index", 3, "binlog.index"), ("./b.1", 4, "b.1")], "entry string, line_no long, name string")
    files = spark.createDataFrame([("b.000001", 10, "x"), ("b.000002", 11, None), ("b.000008", 5, "x")], "name string, size long, added_gtids string")
    listing = spark.createDataFrame([("b.000001", 10), ("b.000002", 12), ("b.000009", 3)], "name string, size long")
    found = {(r.rule, r.name) for r in st.audit_store(index, files, listing, stored_mode="position", marker=False, index_found=False).collect()}
    assert {("V0", None), ("V1", None), ("V2", None), ("V3", "b.000002"), ("V3", "b.1"), ("V4", "binlog.index"), ("V5", "b.000001"), ("V6", "b.1"), ("V7", "b.000009"), ("V8", "b.000008"), ("V9", "b.000002"), ("V10", "b.000002")} <= found


def walk(sizes, limit, head, start=None):
    out, n, at = [], 1, head if start is None else start
    for s in sizes:
        if at >= limit and (out or start is not None):
            n, at = n + 1, head
        out.append(n)
        at += s
    return out


@pytest.mark.parametrize("start", [None, 900, 5000])
def test_packing_equals_walk(spark, start):
    g = random.Random(1)
    sizes = [g.choice([10, 300, 700, 2500]) for _ in range(90)]
    txns = spark.createDataFrame([(1 + i // 20, i, s, 1 + i % 20, i % 20) for i, s in enumerate(sizes)], "file_seq long, txn_no long, size long, sequence_number long, last_committed long")
    packed = rw.pack_transactions(txns, 1024, head=4, open_size=start)
    got = [r.out_file for r in packed.orderBy("txn_no").collect()]
    want = walk(sizes, 1024, 4, start)
    assert [x - got[0] for x in got] == [x - want[0] for x in want]
    renumbered = rw.renumber(packed).collect()
    assert all(0 <= r.new_last_committed < r.new_sequence_number for r in renumbered)


def test_grammar(spark):
    rows = [(1, 0, "rotate", True), (1, 1, "format_description", False), (1, 2, "previous_gtids_log", False), (1, 3, "query", False), (1, 4, "gtid_log", False), (1, 5, "stop", False), (1, 6, "query", False), (2, 0, "gtid_log", False)]
    df = spark.createDataFrame(rows, "file_seq long, ord long, type_name string, artificial boolean")
    assert sorted((r.file_seq, r.position, r.detail) for r in sq.grammar_faults(df).collect()) == [(1, 3, "event before any transaction"), (1, 6, "event after the end"), (2, 0, "no format description first")]


def test_stream_equals_batch(spark, events, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for n, part in enumerate(("event_no in (0, 1)", "event_no in (2, 3, 7, 8)", "event_no in (4, 5, 6, 9)")):
        events.filter(part).coalesce(1).write.parquet(str(source / f"p{n}"))
    rows = stream.read_event_stream(spark, f"{source}/*", events.schema, max_files=1)
    stream.ingest(rows, str(out), str(out / "checkpoint")).awaitTermination()
    assert {r.event_no for r in stream.stored_events(spark, str(out)).collect()} == {0, 1, 2, 3, 4, 5, 6}  # the last transaction waits
    events.filter("event_no = 10").coalesce(1).write.parquet(str(source / "p3"))
    rows = stream.read_event_stream(spark, f"{source}/*", events.schema, max_files=1)
    stream.ingest(rows, str(out), str(out / "checkpoint")).awaitTermination()
    facts = lambda files: {(r.file_seq, r.size, r.last_sequence_number, r.added_gtids) for r in files.collect()}
    assert facts(stream.live_files(spark, str(out))) == facts(fl.build_files(events))


def test_stream_keeps_framing(spark, events, tmp_path):
    """Description, previous ids and a closing rotate are stored; the transaction before the rotate is not lost."""
    source, out = tmp_path / "in", tmp_path / "out"
    frame = lambda no, kind, seq: (f"b.{seq:06d}", seq, no, kind, kind == "artificial", None, None, None, 50, 0, 0, None, None, None, None)
    body = events.filter("file_seq = 1").withColumn("event_no", F.col("event_no") + 10)
    framing = spark.createDataFrame([frame(0, "format_description", 1), frame(1, "previous_gtids_log", 1), frame(30, "rotate", 1), frame(31, "artificial", 2)], EVENT)
    rows = body.unionByName(framing)
    for n, part in enumerate(("event_no < 12", "event_no in (13, 30, 31)", "event_no in (12, 14)")):
        rows.filter(part).coalesce(1).write.parquet(str(source / f"p{n}"))
    stream.ingest(stream.read_event_stream(spark, f"{source}/*", rows.schema, max_files=1), str(out), str(out / "checkpoint")).awaitTermination()
    assert sorted(r.event_no for r in stream.stored_events(spark, str(out)).collect()) == [0, 1, 10, 11, 12, 13, 14, 30]
    live = stream.live_files(spark, str(out)).first()
    assert (live.size, live.last_sequence_number, live.added_gtids[-4:]) == (4 + 195 + 150, 2, ":1-2")
    found = fl.search_by_gtid_set(stream.live_files(spark, str(out)), stream.live_added(spark, str(out)), "11111111-aaaa-1111-aaaa-111111111111:2")
    assert [r.file_seq for r in found.collect()] == [1]


def encoded(ids):
    """Bytes of a set of (uuid, tag, number)."""
    size, tagged = 8, any(t for _, t, _ in ids)
    for key in {(u, t) for u, t, _ in ids}:
        have = {g for u, t, g in ids if (u, t) == key}
        size += 24 + 16 * sum(g - 1 not in have for g in have) + (1 + len(key[1]) if tagged else 0)
    return size


def test_heads_grow_with_the_ids(spark):
    g = random.Random(2)
    pool = [(u, t, n) for u in ("u1", "u2") for t in ("", "tag") for n in range(1, 30)]
    g.shuffle(pool)
    txns = [("s%d" % s, 1 + i // 25, i, g.choice([200, 600, 2000]), *pool[i], i, i) for s in range(2) for i in range(len(pool))]
    df = spark.createDataFrame(txns, "store string, file_seq long, txn_no long, size long, uuid string, tag string, gno long, sequence_number long, last_committed long")
    packed = rw.pack_transactions(rw.file_heads(df, keys=["store"]), 2048, keys=["store"])
    got = {(r.store, r.txn_no): (r.out_file, r.previous_size) for r in packed.collect()}
    framed = {(r.store, r.out_file): r.event_size for r in rw.frame_files(packed, keys=["store"]).filter("ord = -1").collect()}
    for s in ("s0", "s1"):
        at, n, ids = None, 0, set()
        for _, _, i, size, u, t, no, *_ in (x for x in txns if x[0] == s):
            if at is None or at >= 2048:
                n, at = n + 1, 4 + 122 + 23 + encoded(ids)
                assert framed[s, n] == 23 + encoded(ids)
            assert got[s, i] == (n, encoded(ids))
            ids.add((u, t, no))
            at += size


def test_flush_points_equal_a_walk(spark):
    g = random.Random(3)
    rows = [(f, i, g.choice([10, 90, 300])) for f in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "file_seq long, txn_no long, size long")
    want = []
    for f in range(3):
        held = 0
        for _, i, s in (r for r in rows if r[0] == f):
            held += s
            if held >= 1024 or i == 39:
                want.append((f, i))
                held = 0
    assert sorted((r.file_seq, r.txn_no) for r in rw.flush_points(df, 1024).collect()) == want


def test_tagged_size_is_one_choice(spark):
    """The least width that holds itself, near all its limits, by an expression that does not grow with rounds."""
    from pyspark.sql import functions as F

    from logloom.functions.scalars import varlen_size
    from logloom.operators import rewrite as rw

    width = lambda v: next((n for n in range(1, 9) if v < 1 << (7 * n)), 9)
    rows = [(1, 0, r) for n in range(1, 9) for r in range((1 << (7 * n)) - 75, (1 << (7 * n)) - 60)] + [(s, s - 1, 40) for s in (63, 64, 8191, 8192)]
    event, length = rw.tagged_size(F.lit(60), F.col("s"), F.col("c"), F.col("r"))
    got = spark.createDataFrame(rows, "s long, c long, r long").select("s", "c", "r", event.alias("e"), length.alias("l")).collect()
    for r in got:
        own = 60 + width(2 * r.s) + width(2 * r.c)
        want = own + next(n for n in range(1, 10) if width(own + n + r.r) == n)
        assert (r.e, r.l) == (want, want + r.r)
    assert len(str(event._jc)) < 50 * len(str(varlen_size(F.col("s"))._jc))


def test_sizes_of_large_numbers(spark, tmp_path):
    """x8_sizes gives what its SQL gives where numbers pass 2^42."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    ids = [0, 1, 2, 600, 30_000, 344_778, 344_779, 6_000_000, 36_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["x8_sizes"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["x8_sizes"]).fetchall())


def _writers(folder, of):
    """The tasks that wrote files below a folder."""
    import pathlib

    return {p.name.split("-")[1] for p in pathlib.Path(folder).glob(f"{of}=*/part-*")}


def test_records_are_written_side_by_side(spark, tmp_path):
    from logloom.sources import tables as tb

    files = spark.range(40).coalesce(1).selectExpr("concat('f', id) AS name", "id AS size", "timestamp'2024-01-01' AS min_ts", "timestamp'2024-01-02' AS max_ts", "id AS last_sequence_number")
    tb.write_files(files, f"{tmp_path}/files")
    assert len(_writers(f"{tmp_path}/files", "name")) > 1
    assert sorted(r.size for r in tb.read_files(spark, f"{tmp_path}/files").collect()) == list(range(40))


def test_objects_are_written_side_by_side(spark):
    import pathlib

    from logloom.plans import catalog

    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("objects-*"))
    found = catalog.queries()["a5_list_store"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.objects for r in found) == 20
    (made,) = set(root.glob("objects-*")) - before
    assert len(_writers(made, "object")) > 1


def test_checkpoints_in_one_ordered_pass(spark):
    """Files that span batches, by size and time, against a walk event by event; one exchange, no look at every event's next flush."""
    g, rows, expected = random.Random(5), [], []
    for f in range(3):
        held, since, done, ready, now = 0, None, 0, 0, 1_700_000_000
        for n in range(90):
            size, boundary, now = g.randrange(20, 60), g.random() < 0.4, now + g.randrange(4)
            rows.append((f, n, size, boundary, now))
            done += size
            ready, since = done if boundary else ready, now if since is None else since
            if ready > held and (ready >= held + 400 or now >= since + 9):
                expected.append((f, n, 4 + ready, "size" if ready >= held + 400 else "interval"))
                held, since = ready, now
            elif n == 89 and ready > held:
                expected.append((f, n, 4 + ready, "close"))
    events = spark.createDataFrame(rows, "file_seq long, event_no long, event_size long, boundary boolean, t long").withColumn("arrived", F.timestamp_seconds("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rw.checkpoints(events, 400, 9)
        assert sorted(map(tuple, got.collect())) == expected
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_longer_jumps_are_not_made_where_none_leads_on(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rw, "cut", lambda df, name="cut": made.append(name) or df.localCheckpoint())
    jump = spark.range(20).select(F.lit("k").alias("store"), F.col("id").alias("before"), F.when(F.col("id") < 11, F.col("id") + 1).alias("next"))
    start = jump.filter("before = 0").select("store", "before")
    assert sorted(r.before for r in rw._reached(start, jump, ["store"]).collect()) == list(range(12)) and len(made) == 1
