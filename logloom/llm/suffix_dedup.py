"""Removal of long repeated byte strings: a run-length index marks every string of ``length`` bytes that starts at least twice.

1. Any two equal strings of ``length`` bytes have the same smallest hashed ``GRAM``-byte string at the same place (their anchor).  Each
   text is cut into runs of string starts with the same anchor; a run covers a block of bytes.  Only anchors, about one in a hundred bytes,
   are shuffled.
2. Anchors that occur once have no repeated strings.  Blocks that occur twice are repeated as a whole.
3. What is left are different blocks around a common anchor: their bytes meet in a task and are indexed.  The index is a run-length compressed
   Burrows-Wheeler transform with the suffix-array samples at run ends.  Matching statistics stream from the samples: at the first
   place of a run the longest match with the neighbour in suffix order is read off the text; at every other place it is one
   byte shorter than at the place before.  Starts whose longest match has ``length`` bytes are marked.

Blocks of anchors that very many blocks share are cut into cells, named by the contents that all strings of a few neighbouring starts have in common.  Equal
cells are counted; different ones go to the index, or string by string to a count of digests where a cell has very many: no task gathers an unbounded group.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_sized, partitions, saved, sized, slices, table
from .shingles import _BYTE, U, _mix, powers

GRAM = 160
SPLIT = 16
_PLACE_BITS = 24


def prefix_hash(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * powers(len(a) + 1)[0][: len(a)])])


def hash_of(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from begin to end, whatever stands around them."""
    with np.errstate(over="ignore"):
        return _mix((h[end] - h[begin]) * powers(len(h))[1][begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, by running minima inside blocks of ``w`` from either side."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    up = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def runs_of(data: bytes, length: int, gram: int, step: int = 1 << 22):
    """Anchor hash, its place, first and last start of its run, block hash: arrays over the runs of a text.  Very long texts go in steps."""
    n = len(data)
    for at in range(0, max(0, n - length + 1), step):
        part = data[at : at + step + length - 1]
        a = np.frombuffer(part, np.uint8)
        h = prefix_hash(a)
        grams = np.arange(len(a) - gram + 1)
        g = hash_of(h, grams, grams + gram)
        best = sliding_min(g >> U(_PLACE_BITS) << U(_PLACE_BITS) | grams.astype(np.uint64), length - gram + 1)
        place = (best & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        with np.errstate(over="ignore"):
            block = _mix(hash_of(h, first, last + length) + (p - first).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        # equal blocks one after the other (a text that repeats a short string) are two rows: the first, and one that reaches over the others
        same = np.zeros(len(p), bool)
        same[1:] = (g[p[1:]] == g[p[:-1]]) & (block[1:] == block[:-1])
        row = np.cumsum(~same) - 1
        ends = np.append(np.flatnonzero(~same)[1:], len(p)) - 1
        second = same & ~np.concatenate([[False], same[:-1]])
        last = np.where(second, last[ends][row], last)
        keep = ~same | second
        yield g[p].view(np.int64)[keep], (p + at)[keep], (first + at)[keep], (last + at)[keep], block.view(np.int64)[keep]


def _anchors(length: int, gram: int):
    def run(stream):
        import pyarrow as pa

        names = ["anchor", "block", "key", "place", "lo", "hi"]
        for batch in slices(stream):
            out, held = [], 0
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                for g, p, lo, hi, b in runs_of(text.as_buffer().to_pybytes(), length, gram):
                    out.append((g, b, np.full(len(g), key), p, lo, hi))
                    held += len(g)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def _shared(stream):
    """Rows sorted by anchor, block, key, place: of anchors that occur at least twice, whether the block does, and whether the row stands for its block."""
    import pyarrow as pa

    names = ["anchor", "block", "key", "place", "lo", "hi"]
    held, before = None, None  # rows not told yet; the last row told

    def tell(rows, before, more):
        a, b, k, p = rows[:4]
        if before is not None:
            a, b = np.concatenate([[before[0]], a]), np.concatenate([[before[1]], b])
        else:
            a, b = np.concatenate([[~a[0]], a]), np.concatenate([[b[0]], b])
        new_a, new_b = a[1:] != a[:-1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        next_a, next_b = np.append(~new_a[1:], False), np.append(~new_b[1:], False)
        twice, same = ~new_a | next_a, ~new_b | next_b
        m = len(new_a) - (1 if more else 0)
        keep = twice[:m]
        return [r[:m][keep] for r in rows] + [same[:m][keep], new_b[:m][keep]], m

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], [*names, "repeated", "stands"])

    for batch in stream:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        fresh = np.ones(len(rows[0]), bool)  # copies of a text tell of the same places
        fresh[1:] = np.any([r[1:] != r[:-1] for r in (rows[0], rows[1], rows[2], rows[3])], axis=0)
        rows = [r[fresh] for r in rows]
        told, m = tell(rows, before, True)
        if len(told[0]):
            yield batch_of(told)
        if m:
            before = [r[m - 1] for r in rows]
        held = [r[m:] for r in rows]
    if held is not None and len(held[0]):
        told, _ = tell(held, before, False)
        if len(told[0]):
            yield batch_of(told)


def suffix_array(symbols: np.ndarray, block: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array of blocks side by side, by doubling; a suffix ends at its block's end, and equal ones go by block.

    ``symbols`` are bytes plus 1, ``end`` is each place's block end.
    """
    n = len(symbols)
    at = np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(7):
        inside = at + i < end
        key = key << 9 | np.where(inside, symbols[np.minimum(at + i, n - 1)], 0)
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        if depth >= longest or rank[order[-1]] == n:
            break
        inside = at + depth < end
        key = rank << 32 | np.where(inside, rank[np.minimum(at + depth, n - 1)], 0)
        depth *= 2
    return order if rank[order[-1]] == n else np.lexsort((at, block, rank))


class RunIndex:
    """Run-length compressed transform of blocks, with suffix-array samples at the ends of its runs."""

    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) for b in blocks])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(blocks), np.uint8)
        self.end = np.repeat(self.ends, sizes)
        number = np.repeat(np.arange(len(blocks)), sizes)
        sa = suffix_array(self.bytes.astype(np.int64) + 1, number, self.end, int(sizes.max()))
        first = np.zeros(len(self.bytes), bool)
        first[self.begins] = True
        # the transform: the byte before each suffix; block starts have none and are runs of their own
        before = np.where(first[sa], -1, self.bytes[sa - 1].astype(np.int64))
        head = np.ones(len(sa), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)
        self.run_start = np.flatnonzero(head)
        self.run_end = np.append(self.run_start[1:], len(sa)) - 1
        self.run_byte = before[self.run_start]
        self.head_sample, self.tail_sample = sa[self.run_start], sa[self.run_end]
        self.hash = prefix_hash(self.bytes)

    def common_prefix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffixes, by bisection over hashes."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.end[x] - x, self.end[y] - y)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = hash_of(self.hash, x, x + mid) == hash_of(self.hash, y, y + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For every place the longest match with another place, up to the blocks' ends: the better of the two neighbours in suffix order."""
        n = len(self.bytes)
        at = np.arange(n)
        out = np.zeros(n, np.int64)
        for sample, other, ok in (
            (self.head_sample[1:], self.tail_sample[:-1], self.head_sample[:1]),
            (self.tail_sample[:-1], self.head_sample[1:], self.tail_sample[-1:]),
        ):
            value = np.full(n, -1, np.int64)
            value[ok] = 0
            value[sample] = self.common_prefix(sample, other)
            last = np.maximum.accumulate(np.where(value >= 0, at, -1))
            out = np.maximum(out, np.where(last >= 0, value[last] - (at - last), 0))
        return out


def _mark_blocks(length: int, most: int = 1 << 20):
    """Rows sorted by group: indexes whole groups together, up to ``most`` bytes (a larger group alone), and tells which starts are repeated."""

    def solve(keys, los, blocks):
        import pyarrow as pa

        index = RunIndex(blocks)
        starts = np.flatnonzero(index.matching_statistics() >= length)
        if not len(starts):
            return None
        block = np.searchsorted(index.ends, starts, "right")
        place = starts - index.begins[block] + np.array(los)[block]
        edge = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(block) != 0)])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(place)) - 1
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys)[block[first]]), pa.array(place[first]), pa.array(place[last] + length)], ["key", "lo", "hi"])

    def run(stream):
        keys, los, blocks, held, cut = [], [], [], 0, 0
        seen = None
        for batch in stream:
            for g, k, lo, b in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "lo", "bytes"))):
                if seen == (g, k, lo):
                    continue
                if seen is not None and g != seen[0]:
                    if len(blocks) - cut == 1:  # a group of one block matches nothing else
                        held -= len(blocks.pop())
                        keys.pop(), los.pop()
                    cut = len(blocks)
                    if held >= most:
                        if (out := solve(keys, los, blocks)) is not None:
                            yield out
                        keys, los, blocks, held, cut = [], [], [], 0, 0
                seen = (g, k, lo)
                keys.append(k), los.append(lo), blocks.append(b)
                held += len(b)
        if len(blocks) - cut == 1:
            blocks.pop(), keys.pop(), los.pop()
        if len(blocks) > 1 and (out := solve(keys, los, blocks)) is not None:
            yield out

    return run


def _cells(w: dict, length: int):
    """A block's starts by their distance to the anchor, in cells of SPLIT: number, first and last start, and where the bytes that all of a cell's strings share begin."""
    for cell in range((w["place"] - w["hi"]) // SPLIT, (w["place"] - w["lo"]) // SPLIT + 1):
        a, b = max(w["lo"], w["place"] - cell * SPLIT - SPLIT + 1), min(w["hi"], w["place"] - cell * SPLIT)
        if a <= b:
            yield cell, a, b, w["place"] - cell * SPLIT


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


CELLS = "cell binary, content binary, key long, lo long, hi long"


def _name_cells(length: int):
    """The cells of wanted blocks: named by what all strings in one have in common, with a digest of their bytes."""

    def run(stream):
        import pyarrow as pa

        for batch in slices(stream):
            out = []
            for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                data = text.as_buffer().to_pybytes()
                for w in wanted:
                    for cell, a, b, shared in _cells(w, length):
                        inner = data[shared : shared - SPLIT + 1 + length]
                        # equal bytes at another place in the cell are other starts
                        out.append((_digest(inner + b"%d %d" % (w["anchor"], cell)), _digest(data[a : b + length] + b"%d" % (shared - a)), key, a, b + length))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cell", "content", "key", "lo", "hi"])

    return run


def _cut_blocks(stream):
    """The bytes of wanted ranges, in their groups."""
    import pyarrow as pa

    for batch in slices(stream):
        grp, keys, los, parts = [], [], [], []
        for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            data = text.as_buffer().to_pybytes()
            for w in wanted:
                grp.append(w["grp"]), keys.append(key), los.append(w["lo"]), parts.append(data[w["lo"] : w["hi"]])
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.binary()), pa.array(keys, pa.int64()), pa.array(los, pa.int64()), pa.array(parts, pa.binary())], ["grp", "key", "lo", "bytes"])


def _single_starts(length: int):
    """A digest of every string of the wanted ranges."""

    def run(stream):
        import pyarrow as pa

        for batch in slices(stream):
            out = []
            for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                data = text.as_buffer().to_pybytes()
                out += [(_digest(data[i : i + length]), key, i) for w in wanted for i in range(w["lo"], w["hi"] - length + 1)]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], ["string", "key", "lo"])

    return run


def _with_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, text, wanted`` (a list of what is wanted of the text), one row for each text: copies are read once."""
    listed = saved(wanted.groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    once = texts.join(sized(listed.select("key")), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return once.join(listed, "key")


def _large_groups(texts: DataFrame, wanted: DataFrame, length: int, large: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of anchors that very many blocks share, cell by cell: spans that are repeated, and what is left for the index (``key, grp, lo, hi``).

    Equal contents are counted, not gathered.  Of different contents in a cell one each goes to the index; where still more than ``large`` are left, every
    string of theirs is a row of its own, counted by its digest.
    """
    cells = saved(_with_texts(texts, wanted.select("key", F.struct("anchor", "lo", "hi", "place").alias("w"))).mapInArrow(_name_cells(length), CELLS), "cells")
    contents = saved(cells.groupBy("cell", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("w")), "contents")
    again = saved(contents.filter("n > 1").select("cell", "content", F.lit(True).alias("again")), "again")
    spans = left_join_sized(cells, again, ["cell", "content"]).filter("again").select("key", "lo", "hi")
    crowd = saved(contents.groupBy("cell").agg(F.count("*").alias("contents")).filter("contents > 1"), "crowd")
    stand = left_join_sized(contents.select("cell", "w.*"), crowd, ["cell"]).filter("contents > 1")
    stand = saved(stand.select("key", F.col("cell").alias("grp"), "lo", "hi", "contents"), "stand")
    single = _with_texts(texts, stand.filter(F.col("contents") > large).select("key", F.struct("lo", "hi").alias("w"))).mapInArrow(_single_starts(length), "string binary, key long, lo long").distinct()
    single = saved(single, "starts")
    twice = saved(single.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    spans = spans.unionByName(left_join_sized(single, twice, ["string"]).filter("n > 1").select("key", "lo", (F.col("lo") + length).alias("hi")))
    return spans, stand.filter(F.col("contents") <= large).select("key", "grp", "lo", "hi")


def repeated_spans(texts: DataFrame, length: int = 400, gram: int = GRAM, large: int = 2000) -> DataFrame:
    """``key, lo, hi`` of the byte ranges that repeated strings cover (they may overlap), from ``key, text`` (binary, one key for each different text)."""
    spark = texts.sparkSession
    n = partitions(spark)
    rows = texts.filter(F.length("text") >= length).mapInArrow(_anchors(length, gram), "anchor long, block long, key long, place long, lo long, hi long")
    placed = rows.repartition(n, "anchor").sortWithinPartitions("anchor", "block", "key", "place")
    shared = saved(placed.mapInArrow(_shared, "anchor long, block long, key long, place long, lo long, hi long, repeated boolean, stands boolean"), "anchors")
    spans = shared.filter("repeated").select("key", "lo", (F.col("hi") + length).alias("hi"))
    sizes = saved(shared.filter("stands").groupBy("anchor").agg(F.count("*").alias("blocks")).filter("blocks > 1"), "groups")
    stands = shared.filter("stands").join(sized(sizes), "anchor")
    wanted = stands.filter(F.col("blocks") <= large).select("key", F.unhex(F.hex("anchor")).alias("grp"), "lo", (F.col("hi") + length).alias("hi"))
    if not sizes.filter(F.col("blocks") > large).isEmpty():
        more, rest = _large_groups(texts, stands.filter(F.col("blocks") > large), length, large)
        spans, wanted = spans.unionByName(more), wanted.unionByName(rest)
    blocks = _with_texts(texts, wanted.select("key", F.struct("grp", "lo", "hi").alias("w"))).mapInArrow(_cut_blocks, "grp binary, key long, lo long, bytes binary")
    marked = blocks.repartition(n, "grp").sortWithinPartitions("grp", "key", "lo").mapInArrow(_mark_blocks(length), "key long, lo long, hi long")
    return spans.unionByName(marked)


def _strip(stream):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in slices(stream):
        removed, spans, kept = [], [], []
        for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist()):
            data = text.as_buffer().to_pybytes()
            parts, at, gone, n = [], 0, 0, 0
            for m in sorted(marks or [], key=lambda m: (m["lo"], m["hi"])):
                if m["lo"] > at or not n:
                    parts.append(data[at : m["lo"]])
                    n += 1
                    gone += m["hi"] - m["lo"]
                    at = m["hi"]
                elif m["hi"] > at:
                    gone += m["hi"] - at
                    at = m["hi"]
            parts.append(data[at:])
            removed.append(gone), spans.append(n), kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names)


def strip_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, large: int = 2000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; ``kept`` are the bytes that no repeated string covers.

    A text of at least ``length`` bytes that occurs twice is removed whole.  Null texts are empty; shorter texts are kept; repeated rows are
    copies; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    if not gram < length:
        raise ValueError("anchors must be shorter than the strings")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))
    # a key is 64 bits of a text; a second hash tells different texts with one key, which chance makes at most a few: these get keys of another kind
    again = lambda seed: F.xxhash64(F.lit(seed), "text")
    counted = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n"), F.min(again(1)).alias("least"), F.max(again(1)).alias("most"))
    counted = saved(counted.filter("n > 1"), "counted")
    if clash := [r.key for r in counted.filter("least <> most").select("key").collect()]:
        rows = rows.withColumn("key", F.when(F.col("key").isin(clash), again(2)).otherwise(F.col("key")))
        counted = saved(rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counted")
    copies = counted.select("key", F.lit(True).alias("copy"))
    spans = repeated_spans(rows.select("key", "text"), length, gram, large)
    marks = saved(spans.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")), "marks")
    told = left_join_sized(rows, copies, ["key"])
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    single = told.filter("copy is null").join(marks, "key", "left").select("doc_id", "text", "n_bytes", "marks").mapInArrow(_strip, out)
    gone = told.filter("copy").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return single.unionByName(gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = strip_repeats(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"))
