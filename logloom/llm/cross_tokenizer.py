"""How the tokens of two tokenizers lie over each other in every text, and which pairs of ids are linked how often in the corpus.

Both tokenizers cut the same bytes, so a text has two sorted lists of token ends.  The shorter list drives a galloping search into the
longer one: steps that double find a bracket, a binary search inside it gives each end's rank.  Ends found in both lists cut the tokens into
groups, and the ranks of a token's start and end are the range of tokens that it overlaps.

Pair counts are summed in each task before they are shuffled.  To look them up again, the pairs of highest count, a bounded number, go to every worker
as sorted arrays; all others are rare by definition and are joined by a shuffle that no key can make uneven.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import saved, sized, slices, table

#: Ends that are searched for together inside one bracket.
STRIDE = 128
#: Pairs that every worker may hold: 16 bytes each.
HEAD = 1 << 20
#: Pairs that a task holds before it passes their sums on.
HELD = 1 << 21
#: Both tokenizers begin anew at a space between a character that is no space and a visible one: the byte-level pattern takes at most one space to
#: what follows, and no piece of the other model has a space behind another character (proven when it is loaded).
_CUT = re.compile("(?<![ ▁]) (?=[!-~¡-¬®-ȳ])")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For every element of ``short`` how many elements of ``long`` lie below it; both sorted.

    Elements go in strides: from where the last stride ended, steps that double find a bracket for the whole stride, inside which each is searched for by halves.
    """
    out = np.empty(len(short), np.int64)
    n, at = len(long), 0
    for i in range(0, len(short), STRIDE):
        part = short[i : i + STRIDE]
        step, top = STRIDE, part[-1]
        while at + step < n and long[at + step] < top:
            step *= 2
        out[i : i + len(part)] = at + np.searchsorted(long[at : at + step + 1], part)
        at = int(out[i + len(part) - 1])
    return out


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two lists of token ends over the same bytes: for each link its token in ``short`` and in ``long``; for each group its last token in either."""
    rank = gallop(short, long)
    common = long[np.minimum(rank, len(long) - 1)] == short
    # the first token that ends behind this one's start, and the one that holds its last byte
    first = np.concatenate([[0], (rank + common)[:-1]])
    count = rank - first + 1
    of = np.repeat(np.arange(len(short)), count)
    begin = np.repeat(np.cumsum(count) - count, count)
    return of, np.repeat(first, count) + np.arange(len(of)) - begin, np.flatnonzero(common), rank[common]


def code_type(a: int, b: int) -> str:
    return "<u4" if a * b <= 1 << 32 else "<u8"


class Aligner:
    """Two tokenizers, and the bytes of their tokens: ``a`` a byte-level model of the ``tokenizers`` library, ``b`` a ``sentencepiece`` model."""

    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, a: str, b: str, most: int = 300_000, longest: int = 40):
        import sentencepiece

        self.a, self.b = pieces.load(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings are plain text
        back = {chr(n): b for b, n in pieces._BYTE_NAMES.items()}
        letter = lambda c: back[c] if c in back else ord(c)
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special[i].encode() if i in special else bytes(map(letter, self.a.id_to_token(i))) for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.code = code_type(len(self.a_bytes), len(self.b_bytes))
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        # a token's digits and the sign behind it: inside a side of a group, behind the first side, behind the group
        self.text = [f"{i}{sign}" for sign in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.most, self.longest = most, longest

    @classmethod
    def of(cls, a: str, b: str) -> "Aligner":
        """One for each Python worker and pair of files."""
        if (a, b) not in cls._loaded:
            cls._loaded[a, b] = cls(a, b)
        return cls._loaded[a, b]

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Parts that both encode for themselves, each without the space in front of it."""
        head, *rest = _CUT.split(" " + text)
        return [head[1:], *rest] if head else rest

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text (with the space in front) by both."""
        cut = [self._parts(t) if self.cuts else [t] for t in texts]
        fresh = list({p for parts in cut for p in parts} - self.known.keys())
        new = {}
        for i, j in pieces.batches(fresh):
            got = self.a.encode_batch([" " + p for p in fresh[i:j]], add_special_tokens=False)
            for p, x, y in zip(fresh[i:j], got, self.b.encode(fresh[i:j], num_threads=1)):
                new[p] = (np.array(x.ids, "<u4").tobytes(), np.array(y, "<u4").tobytes())
        found = new | self.known if len(new) > len(self.known) else self.known | new
        out = [tuple(np.frombuffer(b"".join([found[p][k] for p in parts]), "<u4") for k in (0, 1)) for parts in cut]
        for p, ids in new.items():
            if len(self.known) < self.most and len(p) <= self.longest:
                self.known[p] = ids
        return out

    def align(self, text: str | None, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, np.ndarray, str]:
        """``n_a, n_b, n_groups``, the code of each link's pair, and the digest of the groups."""
        nothing = (0, 0, 0, np.zeros(0, np.int64), "")
        if not text:
            return nothing
        data = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return nothing
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if len(a) <= len(b):
            of_a, of_b, last_a, last_b = overlaps(a_ends, b_ends)
        else:
            of_b, of_a, last_b, last_a = overlaps(b_ends, a_ends)
        codes = a[of_a].astype(np.int64) * len(self.b_bytes) + b[of_b]
        return len(a), len(b), len(last_a), codes, hashlib.sha256(self.groups(a, b, last_a, last_b)).hexdigest()

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: each token's digits with the sign behind it, put to its place."""
        many = len(self.text) // 3
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[last_a], sign_b[last_b] = many, 2 * many
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        before_b, before_a = np.concatenate([[0], last_b + 1]), last_a + 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_b[group_a]] = a + sign_a
        out[np.arange(len(b)) + before_a[group_b]] = b + sign_b
        return "".join(map(self.text.__getitem__, out.tolist()))[:-1].encode()


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Every document's counts, digest of groups, and ``links``: the code ``a id * size of b + b id`` of each, as little-endian integers of 32 bits if all codes have room there, else of 64.

    Null and empty texts, and texts whose tokens do not add up to their bytes under both models, have no tokens, no links and an empty digest; null ids stay null,
    repeated rows are documents of their own; a table without rows gives none; other columns are ignored.
    """

    def run(stream):
        import pyarrow as pa

        aligner = Aligner.of(a, b)
        for batch in slices(stream, 500):
            texts = batch.column("text").to_pylist()
            for i, j in pieces.batches([t or "" for t in texts], 1_000_000):
                ids = aligner.encode([t or "" for t in texts[i:j]])
                rows = [aligner.align(t, *x) for t, x in zip(texts[i:j], ids)]
                counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                links = [pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[4] for r in rows]), pa.array([r[3].astype(aligner.code).tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *counts, *links], [x.split()[0] for x in ALIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def _codes(batch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch one after the other, and how many each row has."""
    parts = batch.column("links").to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize


def _summed(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of codes with counts as one."""
    codes, at = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([r[1] for r in runs]), len(codes)).astype(np.int64)


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``code, n``: how many links of the corpus hold each pair of ids; ``kind`` is the codes' type.

    A task sorts and sums its links in runs, the runs among themselves, and passes sums on when it holds too many.
    """

    def run(stream):
        import pyarrow as pa

        told = lambda run: pa.RecordBatch.from_arrays([pa.array(run[0].astype(np.int64)), pa.array(run[1])], ["code", "n"])
        runs, parts, held = [], [], 0
        for batch in slices(stream, 500):
            parts.append(_codes(batch, kind)[0])
            held += len(parts[-1])
            if held >= HELD:
                runs.append(np.unique(np.concatenate(parts), return_counts=True))
                parts, held = [], 0
                if sum(len(r[0]) for r in runs) >= HELD:
                    runs = [_summed(runs)]
                    if len(runs[0][0]) >= HELD // 2:
                        yield told(runs.pop())
        runs.append(np.unique(np.concatenate([np.zeros(0, kind), *parts]), return_counts=True))
        yield told(_summed(runs))

    return aligned.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """Adds ``best``: no pair of the same second id has a higher count.  The highest counts are a row for each id of a vocabulary."""
    second = F.pmod(F.col("code"), F.lit(size_b)).alias("second")
    top = counts.groupBy(second).agg(F.max("n").alias("top"))
    return counts.withColumn("second", second).join(F.broadcast(top), "second").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def head_threshold(counts: DataFrame, most: int = HEAD) -> int:
    """The least power of two so that at most ``most`` pairs have that count or a higher one: from a table with a row for each power."""
    sizes = {r.p: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    power, held = max(sizes, default=0) + 1, 0
    while power and held + sizes.get(power - 1, 0) <= most:
        power -= 1
        held += sizes.get(power, 0)
    return 1 << power


def look_up(aligned: DataFrame, counts: DataFrame, kind: str, most: int = HEAD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; ``aligned`` and ``counts`` (with ``best``) are written tables.

    The most frequent pairs are known to every worker; of the others each row gives its codes and how often it has them, which meet their counts by a join.
    Rows with equal id and groups have the same links, so these two name them.
    """
    spark = aligned.sparkSession
    least = head_threshold(counts, most)
    frequent = counts.filter(F.col("n") >= least).toArrow().sort_by("code")  # at most ``most`` rows
    head = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("code", "n", "best")))
    kept = [x.split()[0] for x in ALIGNED.split(", ")][:-1]
    schema = ALIGNED.replace(", links binary", "") + ", n_best long, count_sum long, rare array<struct<code:bigint,times:bigint>>"

    def run(stream):
        import pyarrow as pa

        codes, counts, best = head.value
        rare_type = pa.struct([("code", pa.int64()), ("times", pa.int64())])
        for batch in slices(stream, 500):
            links, sizes = _codes(batch, kind)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            distinct, back = np.unique(links, return_inverse=True)
            distinct = distinct.astype(np.int64)
            at = np.searchsorted(codes, distinct)
            hit = np.zeros(len(distinct), bool)
            hit[at < len(codes)] = codes[at[at < len(codes)]] == distinct[at < len(codes)]
            n, good = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            n[hit], good[hit] = counts[at[hit]], best[at[hit]]
            total = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(v[back])])[ends]))
            lost = np.flatnonzero(~hit[back])
            row = np.repeat(np.arange(len(sizes)), sizes)[lost]
            pairs, times = np.unique(row * len(distinct) + back[lost], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(distinct))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(distinct[pairs % max(1, len(distinct))]), pa.array(times.astype(np.int64))], fields=list(rare_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), total(good), total(n), rare], [*kept, "n_best", "count_sum", "rare"])

    known = aligned.mapInArrow(run, schema)
    out = [*kept[:5], "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return known.select(*out)
    known = saved(known, "known")
    rare = known.filter(F.size("rare") > 0).select("doc_id", "groups_sha256", "rare").dropDuplicates(["doc_id", "groups_sha256"]).select("doc_id", "groups_sha256", F.explode("rare").alias("r"))
    met = rare.select("doc_id", "groups_sha256", "r.*").join(counts.filter(F.col("n") < least), "code")
    more = saved(met.groupBy("doc_id", "groups_sha256").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")), "rare").withColumnRenamed("groups_sha256", "_sha").withColumnRenamed("doc_id", "_id")
    joined = known.join(sized(more), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("groups_sha256") == F.col("_sha")), "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return joined.select(*kept[:5], plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def compare(docs: DataFrame, a: str, b: str, most: int = HEAD) -> DataFrame:
    """Every document with its groups, links, links of the best pair and sum of pair counts (see ``align`` for odd rows)."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    kind = code_type(pieces.load(a).get_vocab_size(), size_b)
    aligned = saved(align(docs, a, b), "aligned")
    counts = saved(pair_counts(aligned, kind), "pair-counts")
    return look_up(aligned, saved(with_best(counts, size_b), "pairs"), kind, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return compare(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
