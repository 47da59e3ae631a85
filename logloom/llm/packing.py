"""Mixture-controlled packing: deficit round-robin over source queues fills every window.

Each source is a queue of tokens.  A window (sequence) of ``size`` tokens owes every queue its share; what a queue is owed
beyond the whole tokens that it got is its deficit, and the window's last places go to the queues with the largest
deficits, one token each.  Deficits are carried from window to window.  Shares are multiples of 1/2**20, so after 256
windows all deficits are zero again and the deficit before *any* window follows from its number alone: a task that
starts in the middle of a queue knows the deficits that all windows before it left, and partitions need not wait for each
other.  When a queue runs dry one window takes what is left, and the others go on with renewed shares.

A queue must be owed at least one token a window.  Sources with a smaller share (beyond ``size`` sources some must be)
share one queue, so there are at most ``size`` queues and their totals may be collected.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces
from .common import partitions, saved, sized, slices, table

UNIT = 1 << 20
PERIOD = 256
#: bytes of the table of buckets (compressed) up to which it is broadcast
BASE_BYTES = 16 << 20
#: pieces that a worker remembers: rare ones recur, and each costs a call of the model
MOST_PIECES = 1_000_000


def shares_of(weights: list[float], size: int) -> np.ndarray:
    """Whole multiples of 1/UNIT, at least one token a window for each, adding up to UNIT."""
    least = UNIT // size
    w = np.asarray(weights, float)
    m = np.maximum(least, np.floor(w / w.sum() * UNIT)).astype(np.int64)
    while (over := int(m.sum()) - UNIT) != 0:
        i = int(np.argmax(m))
        m[i] -= over if over < 0 else min(over, max(1, int(m[i]) - least))
    return m


@lru_cache(maxsize=64)
def _pattern(shares: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a period: the extra tokens that largest deficits have got before it, the quotas, and where in the window each queue starts."""
    m = np.array(shares, np.int64)
    i = np.arange(PERIOD + 1)[:, None]
    owed = i * m * size
    whole, deficit = owed // UNIT, owed % UNIT
    places = size * i[:, 0] - whole.sum(1)
    rank = np.argsort(np.argsort(-deficit, axis=1, kind="stable"), axis=1, kind="stable")
    extra = (rank < places[:, None]).astype(np.int64)
    served = whole + extra
    quota = np.diff(served, axis=0)
    return extra[:PERIOD], quota, np.cumsum(quota, axis=1) - quota


def served(m: int, extra: np.ndarray, i, size: int):
    """Tokens that a queue with share ``m`` has got in the first ``i`` windows."""
    i = np.asarray(i, np.int64)
    return i // PERIOD * (m * size * PERIOD // UNIT) + i % PERIOD * m * size // UNIT + extra[i % PERIOD]


class Schedule:
    """Which windows serve which tokens of each queue: a list of phases, each with constant shares or one explicit window."""

    def __init__(self, totals: list[int], weights: list[float], size: int):
        self.size, self.phases = size, []
        left, at, window = [int(x) for x in totals], [0] * len(totals), 0
        while any(left):
            queues = [q for q, n in enumerate(left) if n]
            shares = shares_of([weights[q] for q in queues], size)
            extra, quota, _ = _pattern(tuple(shares.tolist()), size)
            full = min(self._windows(int(m), extra[:, k], left[q]) for k, (q, m) in enumerate(zip(queues, shares)))
            if full:
                got = [int(served(int(m), extra[:, k], full, size)) for k, m in enumerate(shares)]
                self.phases.append((window, full, queues, [at[q] for q in queues], shares.tolist(), None))
            else:
                full, got = 1, [0] * len(queues)
                room = size
                want = quota[0].tolist()
                while room and any(left[q] > g for q, g in zip(queues, got)):
                    for k, q in enumerate(queues):
                        g = min(max(1, int(want[k])), left[q] - got[k], room)
                        got[k] += g
                        room -= g
                self.phases.append((window, 1, queues, [at[q] for q in queues], None, got))
            window += full
            for q, g in zip(queues, got):
                left[q] -= g
                at[q] += g
        self.windows = window
        self.of_queue = [[] for _ in totals]
        for p, (_, _, queues, begins, _, _) in enumerate(self.phases):
            for k, q in enumerate(queues):
                self.of_queue[q].append((begins[k], p, k))
        self.begins = [np.array([b for b, _, _ in x], np.int64) for x in self.of_queue]

    def _windows(self, m: int, extra: np.ndarray, total: int) -> int:
        """How many windows a queue of ``total`` tokens can serve in full."""
        i = max(0, total * UNIT // (m * self.size) - 2)
        while served(m, extra, i + 1, self.size) <= total:
            i += 1
        return i

    def cut(self, queue: int, a: int, b: int) -> list[np.ndarray]:
        """Pieces of the tokens a to b (exclusive) of a queue: places in the queue from and to, window, offset in the window."""
        out = []
        j = int(np.searchsorted(self.begins[queue], a, "right")) - 1
        while a < b:
            begin, p, k = self.of_queue[queue][j]
            window, count, _, _, shares, explicit = self.phases[p]
            if explicit is not None:
                stop = min(b, begin + explicit[k])
                if stop > a:
                    out.append(np.array([[a], [stop], [window], [sum(explicit[:k]) + a - begin]], np.int64))
            else:
                extra, _, starts = _pattern(tuple(shares), self.size)
                m, e = shares[k], extra[:, k]
                i = max(0, (a - begin) * UNIT // (m * self.size) - 2)
                i1 = min(count, (b - begin) * UNIT // (m * self.size) + 3)
                i = np.arange(i, max(i, i1) + 1)
                edges = begin + served(m, e, i, self.size)
                low, high, w = np.maximum(a, edges[:-1]), np.minimum(b, edges[1:]), i[:-1]
                some = (high > low) & (w < count)
                low, high, w, first = low[some], high[some], w[some], edges[:-1][some]
                out.append(np.stack([low, high, window + w, starts[w % PERIOD, k] + low - first]))
                stop = int(high[-1]) if len(high) else a
            a = max(a, stop)
            j += 1
        return out


def _cut_rows(schedule: Schedule, dtype: np.dtype):
    """For mapInArrow over whole buckets in order: the pieces of each row's ids, with the tokens of the rows before it counted on the way."""

    def run(stream):
        import pyarrow as pa

        pieces.forget()
        names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        cell, after = None, 0
        for batch in slices(stream):
            docs, sources = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
            cells = zip(*(batch.column(c).to_pylist() for c in ("queue", "bucket", "base")))
            doc, source, crc, total, cols = [], [], [], [], []
            for d, s, (q, bucket, base), ids in zip(docs, sources, cells, batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), dtype).astype("<u4")
                # a bucket's rows come one after the other: each begins where the one before it ended
                a = after if cell == (q, bucket) else base
                cell, after = (q, bucket), a + len(ids)
                found = np.concatenate(schedule.cut(q, a, a + len(ids)), axis=1)
                found[:2] -= a
                data = memoryview(ids.tobytes())
                crc += [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(found[0].tolist(), found[1].tolist())]
                n = found.shape[1]
                doc += [d] * n
                source += [s] * n
                total += [len(ids)] * n
                cols.append(found)
            low, high, window, offset = np.concatenate(cols, axis=1) if cols else np.zeros((4, 0), np.int64)
            arrays = [pa.array(doc, pa.int64()), pa.array(source, pa.string()), *(pa.array(x, pa.int64()) for x in (low, high - low, crc, total, window, offset))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every document.

    ``targets`` gives sources' proportions; sources not named share one queue, with what is left to 1 (at least one token
    a window).  Without targets every source gets its own share of all tokens, so that all queues end together.  Null texts are
    empty and consist of the end id; a null source is a source; repeated rows are documents of their own; an empty
    table gives no pieces.  Within a queue documents follow a hash order, which needs no global sort.  Only the last
    sequence is not full; it is padded to a power of two.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    encoded = rows.mapInArrow(pieces.encode_rows(tokenizer, "text", ["doc_id", "source"], end_id, MOST_PIECES), "doc_id long, source string, n_tokens long, ids binary")
    # the hash is a column of its own, so that ids are read only where they are cut
    tokens = saved(encoded.withColumn("hash", F.xxhash64("doc_id", "ids")), "pack-tokens")
    dtype = pieces.id_type(pieces.load(tokenizer).get_vocab_size())
    by_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    out = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not total:
        return spark.createDataFrame([], out)
    if targets is None:
        own = sorted((r.source or "", r.source is None, r.n) for r in by_source.filter(F.col("n") * size >= total).collect())  # at most `size` rows
        named, weights = [(None if null else s) for s, null, _ in own], [float(n) for *_, n in own]
    else:
        if len(targets) >= size:
            raise ValueError("more targets than tokens in a window")
        named, weights = list(targets), list(targets.values())
    totals = {r.source: r.n for r in by_source.filter(F.coalesce(F.col("source").isin([s for s in named if s is not None]), F.lit(False)) | F.lit(None in named) & F.col("source").isNull()).collect()} if named else {}
    counts = [totals.get(s, 0) for s in named]
    rest = total - sum(counts)
    if rest and (targets is not None or rest * size >= total or not named):
        home = len(named)
        counts.append(rest)
        weights.append(max(1.0 - sum(weights), sum(weights) / size, 1.0 / size) if targets is not None else float(rest))
    else:
        home = int(np.argmin(counts)) if rest else 0
        if rest:
            counts[home] += rest
            weights[home] += rest
    schedule = Schedule(counts, weights, size)
    mapped = spark.createDataFrame([(s, s is None, q) for q, s in enumerate(named)], "name string, none boolean, queue int")
    placed = tokens.join(F.broadcast(mapped), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("queue", F.coalesce("queue", F.lit(home)))
    # a queue's order: buckets by hash, then doc_id; the running total inside a bucket (counted while it is read) plus the totals of the buckets before it
    placed = placed.withColumn("bucket", F.pmod("hash", F.lit(2 * partitions(spark))).cast("int"))
    cell = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("queue", "bucket").agg(F.sum("n_tokens").alias("n")).select("queue", "bucket", F.coalesce(F.sum("n").over(cell), F.lit(0)).alias("base"))
    base = saved(base, "pack-base")
    whole = placed.join(sized(base, BASE_BYTES, 4 * BASE_BYTES), ["queue", "bucket"]).select("doc_id", "source", "queue", "bucket", "base", "ids")
    ready = whole.repartition("queue", "bucket").sortWithinPartitions("queue", "bucket", "doc_id", "ids")
    return ready.mapInArrow(_cut_rows(schedule, dtype), out)


#: The mixture of the query: these sources' shares of every window while they last; all others share the rest.
MIXTURE = {"src0": 0.30, "src1": 0.10, "src2": 0.08}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), targets=MIXTURE)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
