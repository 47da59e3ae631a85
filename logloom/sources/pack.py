"""Packs log files byte by byte: what a source would have written, for tests and for queries that read raw files."""

import struct
import zlib

from .binlog import MAGIC, known_lengths


def varlen(v: int) -> bytes:
    for n in range(1, 9):
        if v < 1 << (7 * n):
            return (v << n | (1 << (n - 1)) - 1).to_bytes(n, "little")
    return b"\xff" + v.to_bytes(8, "little")


def signed(v: int) -> bytes:
    return varlen(v << 1 if v >= 0 else ~(v << 1))


def packed(v: int) -> bytes:
    if v < 251:
        return bytes([v])
    for mark, n in ((252, 2), (253, 3), (254, 8)):
        if v < 1 << (8 * n):
            return bytes([mark]) + v.to_bytes(n, "little")
    raise ValueError


class Log:
    def __init__(self, crc=True):
        self.data, self.crc, self.passed_on = bytearray(MAGIC), crc, 0

    def drain(self) -> bytes:
        """What was packed since the last call; positions go on."""
        out, self.passed_on = bytes(self.data), self.passed_on + len(self.data)
        self.data.clear()
        return out

    def event(self, code, rest, ts=1_700_000_000, flags=0, always=False, break_crc=False):
        footer = 4 if self.crc or always else 0
        size = 19 + len(rest) + footer
        e = struct.pack("<IBIIIH", ts, code, 1, size, self.passed_on + len(self.data) + size & 0xFFFFFFFF, flags) + rest
        self.data += e + (((zlib.crc32(e) ^ break_crc) if self.crc else 0).to_bytes(4, "little") if footer else b"")
        return self

    def description(self, version=b"8.4.8", code=80408):
        rest = struct.pack("<H50sIB", 4, version, 1_700_000_000, 19) + bytes(known_lengths(code)) + bytes([int(self.crc)])
        return self.event(15, rest, always=True)

    def previous(self, sets=()):
        return self.event(35, len(sets).to_bytes(8, "little") + b"".join(u + len(i).to_bytes(8, "little") + b"".join(struct.pack("<QQ", a, b + 1) for a, b in i) for u, i in sets))

    def gtid(self, uuid, gno, committed, number, length, original=None, version=80408, first=None, ticket=None, code=33):
        post = struct.pack("<B16sqBQQ", 1, uuid, gno, 2, committed, number)
        body = (1_700_000_000_000_000 | ((1 << 55) if original else 0)).to_bytes(7, "little") + (original.to_bytes(7, "little") if original else b"") + packed(length)
        body += (version | ((1 << 31) if first else 0)).to_bytes(4, "little") + (first.to_bytes(4, "little") if first else b"") + (ticket.to_bytes(8, "little") if ticket else b"")
        return self.event(code, post + body)

    def tagged(self, uuid, tag, gno, committed, number, length):
        fields = b"".join([varlen(0) + varlen(1), varlen(1) + b"".join(varlen(x) for x in uuid), varlen(2) + signed(gno), varlen(3) + varlen(len(tag)) + tag, varlen(4) + signed(committed), varlen(5) + signed(number), varlen(6) + varlen(1_700_000_000_000_001), varlen(8) + varlen(length), varlen(9) + varlen(80408)])
        n = len(fields) + 3
        return self.event(42, varlen(1) + varlen(n) + varlen(0) + fields)

    def rotate(self, name, position=4, flags=0):
        return self.event(4, position.to_bytes(8, "little") + name.encode(), flags=flags)


def pack_transaction(log: Log, uuid: str, tag: str, gno: int, committed: int, number: int, sizes: list[tuple[int, int]], broken: bool = False) -> None:
    """An id event whose length counts itself, and events of given codes and sizes behind it."""
    key, rest = bytes.fromhex(uuid.replace("-", "")), sum(n for _, n in sizes)
    begin = lambda to, length: to.tagged(key, tag.encode(), gno, committed, number, length) if tag else to.gtid(key, gno, committed, number, length)
    length = rest
    for _ in range(4):  # the length's own width settles at once or after a step
        length = rest + len(begin(Log(log.crc), length).data) - len(MAGIC)
    begin(log, length)
    for i, (code, n) in enumerate(sizes):
        log.event(code, bytes(n - 19 - (4 if log.crc else 0)), break_crc=broken and i == len(sizes) - 1)
