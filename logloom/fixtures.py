"""Log-shaped tables derived from the generic test tables, in SQL that runs alike in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

U1, U2, U3 = "11111111-aaaa-1111-aaaa-111111111111", "22222222-bbbb-2222-bbbb-222222222222", "33333333-cccc-3333-cccc-333333333333"

LOG_EVENTS = f"""
SELECT event_no, file, file_seq, txn_no, CAST(pos_in_txn AS BIGINT) AS pos_in_txn, ts, type_name, uuid, tag, gno, event_size,
       next_pos - event_size AS start_pos, next_pos, txn_length, sequence_number,
       greatest(sequence_number - 1 - txn_no % 4, CAST(0 AS BIGINT)) AS last_committed
FROM (
  SELECT *, CAST(4 + sum(event_size) OVER (PARTITION BY file_seq ORDER BY event_no) AS BIGINT) AS next_pos,
         CAST(sum(event_size) OVER (PARTITION BY txn_no) AS BIGINT) AS txn_length,
         CAST(dense_rank() OVER (PARTITION BY file_seq ORDER BY txn_no) AS BIGINT) AS sequence_number
  FROM (
    SELECT event_no, ts, file_seq, txn_no, pos_in_txn, concat('binlog.', lpad(CAST(file_seq AS STRING), 6, '0')) AS file,
           CASE txn_no % 3 WHEN 0 THEN '{U1}' WHEN 1 THEN '{U2}' ELSE '{U3}' END AS uuid,
           CASE WHEN txn_no % 7 = 0 THEN 'alpha' ELSE '' END AS tag,
           CAST((txn_no - txn_no % 3) / 3 AS BIGINT) + 1 AS gno,
           CASE pos_in_txn WHEN 0 THEN 'gtid_log' WHEN 1 THEN 'query' WHEN 4 THEN 'xid' ELSE 'write_rows' END AS type_name,
           CAST(23 + length(event_type) + length(props) + CASE WHEN pos_in_txn = 0 THEN 42 ELSE 0 END AS BIGINT) AS event_size
    FROM (
      SELECT event_id AS event_no, event_type, props, date_trunc('second', ts) AS ts,
             CAST((event_id - event_id % 500) / 500 AS BIGINT) + 1 AS file_seq,
             CAST((event_id - event_id % 5) / 5 AS BIGINT) AS txn_no, event_id % 5 AS pos_in_txn
      FROM {{events}}
    ) numbered WHERE txn_no % 97 <> 13
  ) typed
) summed
"""

_BOUNDS = "(SELECT file_seq, file, min(ts) AS ts0, max(ts) AS ts1 FROM log_events GROUP BY file_seq, file)"
_NO_ID = "CAST(NULL AS STRING) AS uuid, CAST(NULL AS STRING) AS tag, CAST(NULL AS BIGINT) AS gno, CAST(NULL AS BIGINT) AS txn_length, CAST(NULL AS BIGINT) AS sequence_number, CAST(NULL AS BIGINT) AS last_committed"
FRAMED_EVENTS = f"""
SELECT file_seq, file, ord, type_name, artificial, event_size, ts, txn_no, uuid, tag, gno, txn_length, sequence_number, last_committed,
       CASE WHEN artificial THEN CAST(0 AS BIGINT) ELSE
         CAST(4 + sum(CASE WHEN artificial THEN 0 ELSE event_size END) OVER (PARTITION BY file_seq ORDER BY ord) AS BIGINT) END AS next_pos
FROM (
  SELECT file_seq, file, CAST(-3 AS BIGINT) AS ord, 'rotate' AS type_name, TRUE AS artificial, CAST(27 + length(file) AS BIGINT) AS event_size,
         CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS txn_no, {_NO_ID} FROM {_BOUNDS} b
  UNION ALL SELECT file_seq, file, CAST(-2 AS BIGINT), 'format_description', FALSE, CAST(123 AS BIGINT), ts0, CAST(NULL AS BIGINT), {_NO_ID} FROM {_BOUNDS} b
  UNION ALL SELECT file_seq, file, CAST(-1 AS BIGINT), 'previous_gtids_log', FALSE, CAST(31 AS BIGINT), ts0, CAST(NULL AS BIGINT), {_NO_ID} FROM {_BOUNDS} b
  UNION ALL SELECT file_seq, file, event_no, type_name, FALSE, event_size, ts, txn_no, uuid, tag, gno, txn_length, sequence_number, last_committed FROM log_events
  UNION ALL SELECT file_seq, file, CAST(9000000000 AS BIGINT), CASE WHEN file_seq % 4 = 0 THEN 'stop' ELSE 'rotate' END, FALSE,
         CAST(CASE WHEN file_seq % 4 = 0 THEN 23 ELSE 31 + length(file) END AS BIGINT), ts1, CAST(NULL AS BIGINT), {_NO_ID} FROM {_BOUNDS} b WHERE file_seq % 5 <> 0
) u
"""

#: files that lack their description, and files that lack their previous ids
FRAMED_EVENTS_BAD = "SELECT * FROM framed_events WHERE NOT (file_seq % 6 = 0 AND ord = -2) AND NOT (file_seq % 3 = 1 AND ord = -1)"

#: files that end within a transaction
LOG_EVENTS_CUT = "SELECT * FROM log_events WHERE event_no % 500 < 497"

LOG_EVENTS_BAD = """
SELECT event_no, file, file_seq, txn_no, pos_in_txn, ts, type_name, uuid, tag, gno, event_size, start_pos,
       CASE WHEN event_no % 1009 = 100 THEN next_pos + 1 ELSE next_pos END AS next_pos,
       CASE WHEN txn_no % 101 = 50 THEN txn_length + 1 ELSE txn_length END AS txn_length, sequence_number,
       CASE WHEN txn_no % 103 = 7 THEN sequence_number ELSE last_committed END AS last_committed
FROM log_events
"""

INTERVAL_ROWS = f"""
SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END AS set_id,
       CASE o_custkey % 3 WHEN 0 THEN '{U1}' WHEN 1 THEN '{U2}' ELSE '{U3}' END AS uuid,
       CASE WHEN o_custkey % 5 = 0 THEN 'alpha' ELSE '' END AS tag,
       o_orderkey + 1 AS lo, o_orderkey + 1 + o_custkey % 9 AS hi,
       CAST((o_orderkey - o_orderkey % 250) / 250 AS BIGINT) + 1 AS file_seq
FROM {{orders}}
"""

LOG_FILES = """
SELECT file_seq, file AS name, CAST(4 + sum(event_size) AS BIGINT) AS size, min(ts) AS min_ts, max(ts) AS max_ts,
       max(sequence_number) AS last_sequence_number
FROM log_events GROUP BY file_seq, file
"""

FILE_ADDED_GTIDS = """
SELECT file_seq, uuid, tag, min(gno) AS lo, max(gno) AS hi FROM (
  SELECT *, gno - row_number() OVER (PARTITION BY file_seq, uuid, tag ORDER BY gno) AS isl
  FROM (SELECT DISTINCT file_seq, uuid, tag, gno FROM log_events WHERE pos_in_txn = 0) g
) r GROUP BY file_seq, uuid, tag, isl
"""

#: a catalogue whose clock runs backwards now and then, kept in three stores
CLOCK_FILES = """
SELECT concat('s', CAST(file_seq % 3 AS STRING)) AS store, file_seq, name, size,
       CASE WHEN file_seq % 7 = 0 THEN min_ts + INTERVAL 3 DAY ELSE min_ts END AS min_ts, max_ts, last_sequence_number
FROM log_files
"""

#: index, metadata and listing of a store with faults
STORE_INDEX = "SELECT './' || name AS entry, file_seq AS line_no, name FROM log_files WHERE file_seq % 11 <> 0"
STORE_METADATA = "SELECT name, size + CASE WHEN file_seq % 9 = 4 THEN 1 ELSE 0 END AS size, CASE WHEN file_seq % 6 = 5 THEN CAST(NULL AS STRING) ELSE 'x:1' END AS added_gtids FROM log_files WHERE file_seq % 8 <> 3"
STORE_LISTING = "SELECT name, size FROM log_files WHERE file_seq % 13 <> 5"

VIEWS = {
    "log_events": LOG_EVENTS,
    "framed_events": FRAMED_EVENTS,
    "framed_events_bad": FRAMED_EVENTS_BAD,
    "log_events_cut": LOG_EVENTS_CUT,
    "log_events_bad": LOG_EVENTS_BAD,
    "interval_rows": INTERVAL_ROWS,
    "log_files": LOG_FILES,
    "file_added_gtids": FILE_ADDED_GTIDS,
    "clock_files": CLOCK_FILES,
    "store_index": STORE_INDEX,
    "store_metadata": STORE_METADATA,
    "store_listing": STORE_LISTING,
}


def write_raw_logs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The log of ``log_events`` as raw files, each packed by one task from rows in order.

    Files begin with a description (of a server 9.1.0 where the number leaves 7 of 9) and previous ids (numbers up to the file's of one source) and end with a rotate; the last
    event has a broken checksum where the number leaves 5 of 9.  Events but ids have the sizes of the view, 36 at least.
    """
    from .sources.pack import Log, pack_transaction

    codes = {"query": 2, "write_rows": 30, "xid": 16}
    columns = ["file_seq", "file", "event_no", "txn_no", "type_name", "event_size", "uuid", "tag", "gno", "sequence_number", "last_committed"]

    def run(stream):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder)
        log = sink = at = None
        txn, told = [], []

        def close_txn(broken=False):
            if txn:
                head = txn[0]
                pack_transaction(log, head["uuid"], head["tag"], head["gno"], head["last_committed"], head["sequence_number"], [(codes[r["type_name"]], max(36, r["event_size"])) for r in txn[1:]], broken)
                txn.clear()
                sink.write(log.drain())

        def close_file():
            close_txn(at[0] % 9 == 5)
            log.rotate("binlog.%06d" % (at[0] + 1))
            sink.write(log.drain())
            sink.close()
            told.append(at[1])

        for batch in stream:
            for r in batch.to_pylist():
                if at != (r["file_seq"], r["file"]):
                    if at:
                        close_file()
                    at = (r["file_seq"], r["file"])
                    sink, log = filesystem.open_output_stream(f"{base}/{at[1]}", compression=None), Log()
                    log.description(*((b"9.1.0", 90100) if at[0] % 9 == 7 else ())).previous([(bytes.fromhex(U1.replace("-", "")), [(1, at[0])])])
                if txn and txn[0]["txn_no"] != r["txn_no"]:
                    close_txn()
                txn.append(r)
        if at:
            close_file()
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.string())], ["file"])

    spark.createDataFrame([], "x int").write.mode("append").parquet(f"{folder}/_made")  # the folder
    rows = view(spark, sf_dir, "log_events").select(*columns).repartition("file_seq").sortWithinPartitions("file_seq", "event_no")
    rows.mapInArrow(run, "file string").write.mode("append").parquet(f"{folder}/_made")


def _needed(sql: str) -> list[str]:
    """The views that a text uses, each after those it uses itself."""
    import re

    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str, **names: str) -> str:
    """``sql`` with the views it uses in front, base tables under the given names."""
    tables = {"events": "events", "orders": "orders"} | names
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**tables)})" for v in _needed(sql))
    return f"WITH {views} {sql}" if views else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
    text = with_views(f"SELECT * FROM {name}", events="{events}", orders="{orders}")
    used = {t: read(t) for t in ("events", "orders") if "{" + t + "}" in text}
    return spark.sql(text, **used)
