"""Column expressions: names, ids, versions, times, event codes.  Nothing here runs Python for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_GNO = 2**63 - 1


# -- file names ------------------------------------------------------------------------------------------------------

def binlog_base(name: Column) -> Column:
    """``base`` of ``base.000123``."""
    return F.regexp_extract(name, r"^(.*)\.[0-9]{6}$", 1)


def binlog_seq(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"\.([0-9]{6})$", 1), F.lit("")), F.lit("999999")).cast("int")


def output_name(base: Column, n: Column) -> Column:
    """``base.%06d``."""
    return F.concat(base, F.lit("."), F.lpad(n.cast("string"), 6, "0"))


def binlog_next(name: Column) -> Column:
    return output_name(binlog_base(name), binlog_seq(name) + 1)


def name_fault(name: Column) -> Column:
    """Why a name is no log file name, or NULL: too short, no dot before the last six characters, no digits, no base, a path, number 0."""
    seven = F.substring(name, -7, 1)
    digits = F.right(name, F.lit(6))
    return (
        F.when(F.length(name) <= 6, "too short")
        .when(seven != ".", "no separator")
        .when(~digits.rlike("^[0-9]{6}$"), "not a number")
        .when(F.length(name) == 7, "empty base")
        .when(name.contains("/"), "path separator")
        .when(digits == "000000", "number zero")
    )


def file_uri(root: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), name)


# -- transaction ids -------------------------------------------------------------------------------------------------

def uuid_text(binary: Column) -> Column:
    """Sixteen bytes as lower-case 8-4-4-4-12."""
    h = F.lower(F.hex(binary))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def format_gtid(uuid: Column, tag: Column, gno: Column) -> Column:
    return F.concat_ws(":", uuid, F.nullif(tag, F.lit("")), gno.cast("string"))


def is_valid_tag(tag: Column) -> Column:
    """Empty, or a letter or underscore and up to 31 more letters, digits or underscores."""
    return tag.rlike("^([A-Za-z_][A-Za-z0-9_]{0,31})?$")


def is_valid_gno(gno: Column) -> Column:
    return gno.between(1, MAX_GNO)


# -- times and versions ----------------------------------------------------------------------------------------------

def parse_time(text: Column) -> Column:
    """Strict ``yyyy-MM-ddTHH:mm:ss``; anything else is NULL."""
    shaped = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$")
    return F.when(shaped, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def print_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def micros_text(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def version_code(text: Column) -> Column:
    """``major * 10000 + minor * 100 + patch``; what follows a hyphen is dropped."""
    part = lambda i: F.get(F.split(F.substring_index(text, "-", 1), r"\."), F.lit(i)).cast("int")
    return part(0) * 10000 + part(1) * 100 + part(2)


def version_text(code: Column) -> Column:
    return F.concat_ws(".", F.floor(code / 10000).cast("string"), F.floor(code % 10000 / 100).cast("string"), (code % 100).cast("string"))


# -- sizes of encoded numbers ----------------------------------------------------------------------------------------

def packed_size(x: Column) -> Column:
    """Bytes of a packed integer: 1, 3, 4 or 9."""
    return F.when(x < 251, 1).when(x < 1 << 16, 3).when(x < 1 << 24, 4).otherwise(9)


def varlen_size(x: Column) -> Column:
    """Bytes of a variable-length integer: seven bits a byte, nine bytes beyond eight of them."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(x < F.lit(1 << (7 * n)), n).otherwise(size)
    return size


# -- event codes -----------------------------------------------------------------------------------------------------

#: fixed values: event codes of the log format
EVENT_TYPES = {
    0: "unknown", 1: "start_v3", 2: "query", 3: "stop", 4: "rotate", 5: "intvar", 6: "obsolete_6", 7: "slave", 8: "obsolete_8",
    9: "append_block", 10: "obsolete_10", 11: "delete_file", 12: "obsolete_12", 13: "rand", 14: "user_var", 15: "format_description",
    16: "xid", 17: "begin_load_query", 18: "execute_load_query", 19: "table_map", 20: "obsolete_20", 21: "obsolete_21",
    22: "obsolete_22", 23: "write_rows_v1", 24: "update_rows_v1", 25: "delete_rows_v1", 26: "incident", 27: "heartbeat_log", 28: "ignorable_log",
    29: "rows_query_log", 30: "write_rows", 31: "update_rows", 32: "delete_rows", 33: "gtid_log", 34: "anonymous_gtid_log",
    35: "previous_gtids_log", 36: "transaction_context", 37: "view_change", 38: "xa_prepare_log", 39: "partial_update_rows",
    40: "transaction_payload", 41: "heartbeat_log_v2", 42: "gtid_tagged_log",
}
#: fixed values: header flags, lowest bit first
EVENT_FLAGS = {0x1: "binlog_in_use", 0x4: "thread_specific", 0x8: "suppress_use", 0x20: "artificial", 0x40: "relay_log", 0x80: "ignorable", 0x100: "no_filter", 0x200: "mts_isolate"}
#: fixed values: lengths of post headers by event code from 1 on, for servers before 8.3
POST_HEADER_LENGTHS = [0, 13, 0, 8, 0, 0, 0, 0, 4, 0, 4, 0, 0, 0, 98, 0, 4, 26, 8, 0, 0, 0, 8, 8, 8, 2, 0, 0, 0, 10, 10, 10, 42, 42, 0, 18, 52, 0, 10, 40, 0]

TXN_STARTS = ("gtid_log", "anonymous_gtid_log", "gtid_tagged_log")
FRAMING = ("rotate", "format_description", "previous_gtids_log", "stop")


def event_type_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), code)


def has_flag(flags: Column, name: str) -> Column:
    mask = next(m for m, n in EVENT_FLAGS.items() if n == name)
    return flags.bitwiseAND(F.lit(mask)) != 0


def event_flags(flags: Column) -> Column:
    """Names of the known flags, lowest bit first, with `` | `` between."""
    return F.concat_ws(" | ", *[F.when(flags.bitwiseAND(F.lit(m)) != 0, F.lit(n)) for m, n in EVENT_FLAGS.items()])


def is_txn_start(type_name: Column) -> Column:
    return type_name.isin(*TXN_STARTS)


def is_file_end(type_name: Column, artificial: Column) -> Column:
    return (type_name == "stop") | ((type_name == "rotate") & ~artificial)


def post_header_len(version: Column, code: Column) -> Column:
    """Length of an event's post header; NULL for a code the version does not know."""
    tail = len(POST_HEADER_LENGTHS)
    old = F.get(F.array(*[F.lit(x) for x in POST_HEADER_LENGTHS]), code - 1)
    # from 8.3 on there is one more code, so the description's table is a byte longer; the old row events have none
    return F.when(version < 80300, old).when(code == 15, 99).when(code.between(23, 25) | (code == tail + 1), 0).otherwise(old)


def body_len(event_size: Column, post_header: Column, footer: Column) -> Column:
    return event_size - 19 - post_header - footer
