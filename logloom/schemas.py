"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "ticket": T.DecimalType(20, 0), "ints": T.ArrayType(T.IntegerType())}


def struct(text: str, **nested: T.DataType) -> T.StructType:
    """``name kind`` pairs; kinds are short names or keys of ``nested``."""
    return T.StructType([T.StructField(*pair) for pair in ((n, (nested | _KINDS)[k]) for n, k in (p.split() for p in text.split(",")))])


EVENTS = struct(
    "file string, file_base string, file_seq int, event_no long, start_pos long, next_pos long, event_size long, ts timestamp, type_code int, "
    "type_name string, server_id long, flags int, post_header_len int, body_len int, footer_len int, has_checksum boolean, crc_ok boolean, gtid gtid, "
    "last_committed long, sequence_number long, txn_length long, immediate_commit_ts timestamp, original_commit_ts timestamp, "
    "immediate_server_version int, original_server_version int, commit_group_ticket ticket, rotate rotate, fde fde, previous_gtids intervals, payload binary",
    gtid=struct("uuid string, tag string, gno long"),
    rotate=struct("position long, file string"),
    fde=struct("binlog_version int, server_version string, create_ts timestamp, header_len int, post_header_lens ints, checksum_alg string"),
    intervals=T.ArrayType(struct("uuid string, tag string, lo long, hi long")),
)
METADATA = struct("version int, size long, previous_gtids string, added_gtids string, min_timestamp string, max_timestamp string, last_sequence_number long, name string, _corrupt string")
INTERVALS = struct("set_id string, uuid string, tag string, lo long, hi long")
