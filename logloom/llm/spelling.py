"""Spelling variants: words one edit apart, and for each the much more frequent word that it is a form of.

Words are rows of letter counts.  One insertion or deletion moves a row by a squared distance of 1, a replacement by 2, so pairs within 2 of
equal or neighbouring length are all that need a look at their letters; the squared distances of two blocks of words are one matrix product.

Blocks hold words of one length and of equal counts in five classes of letters.  An edit adds a letter to one class, takes one from it, or moves one
from a class to another: a word meets, besides its own block, only those a fixed number of such steps away.  Blocks above a bound are split, each part
meeting all that a block meets.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_sized, partitions, saved, slices, table

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Letters by class; all others are the last class.  Any choice is right; these hold about a fifth of running text each.
CLASSES = ("ae", "iou", "tns", "rlhd")
#: Letters a-z, then those from U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Different words that a task counts before it passes its sums on.
HELD = 200_000
#: Words of a block, and of the rows that meet it at a time.
BLOCK, CHUNK = 4096, 1024


def _counted(least: int, every: int):
    """For mapInArrow over ``doc_id, text``: ``word, n``, summed over what the task has seen."""

    def run(stream):
        import pyarrow as pa

        counts: dict[bytes, int] = {}
        held = 0
        told = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in slices(stream, 500):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                # one byte for each character: those without one become a sign, which ends a run
                runs = _RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower())
                mine: dict[bytes, int] = {}
                for w in runs:
                    mine[w] = mine.get(w, 0) + 1
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for w, n in mine.items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if not h % every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    if w in counts:
                        counts[w] += n
                    else:
                        counts[w] = n
                        held += 100 + len(w)
                if held >= HELD * 110:
                    yield told()
                    counts.clear()
                    held = 0
        yield told()

    return run


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """``word, n`` of whole texts: runs of letters, A-Z lower-cased; a run loses a letter where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_letters, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _steps() -> list[tuple[int, tuple[int, ...]]]:
    """Where a word looks besides its own block, as changes of length and class counts; each unordered pair of blocks once."""
    k = len(CLASSES) + 1
    unit = lambda i: tuple(int(i == j) for j in range(k))
    less = [(-1, tuple(-x for x in unit(i))) for i in range(k)]
    moved = [(0, tuple(b - a for a, b in zip(unit(i), unit(j)))) for i in range(k) for j in range(i + 1, k)]
    return less + moved


def blocks(words: DataFrame) -> DataFrame:
    """``cell, part, guest, word, n``: each word in its own block and, as a guest, in all parts of the blocks that it looks into."""
    of = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in CLASSES]
    shape = words.withColumn("_len", F.length("word").cast("int")).withColumn("_c", F.array(*[c.cast("int") for c in of]))
    shape = shape.withColumn("_c", F.concat("_c", F.array((F.col("_len") - F.aggregate("_c", F.lit(0), lambda a, b: a + b)).cast("int"))))
    cell = lambda step: F.concat_ws(",", (F.col("_len") + step[0]).cast("string"), *[(F.get("_c", F.lit(i)) + d).cast("string") for i, d in enumerate(step[1])])
    fits = lambda step: F.expr(" and ".join([f"_c[{i}] > 0" for i, d in enumerate(step[1]) if d < 0] or ["true"]))
    own = (0, (0,) * (len(CLASSES) + 1))
    homes = shape.select(cell(own).alias("cell"), "word", "n")
    sizes = homes.groupBy("cell").agg(F.count("*").alias("size"))
    looks = shape.select("word", "n", F.explode(F.array_compact(F.array(*[F.when(fits(s), cell(s)) for s in _steps()]))).alias("cell"))
    # a block that nobody lives in needs no guests
    sizes = saved(sizes, "cells")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    home = left_join_sized(homes, sizes, ["cell"]).select("cell", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.lit(0).alias("guest"), "word", "n")
    # parts of a split block also look into the parts before them
    again = left_join_sized(homes, sizes, ["cell"]).filter(F.col("size") > BLOCK).withColumn("_own", F.pmod(F.xxhash64("word"), parts).cast("int")).filter("_own > 0")
    again = again.select("cell", F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("part"), F.lit(1).alias("guest"), "word", "n")
    guest = left_join_sized(looks, sizes, ["cell"]).filter("size is not null").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("guest"), "word", "n")
    return home.unionByName(again).unionByName(guest)


class _Words:
    """Words of one length: their letters, letter counts and frequencies."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        index = np.where(self.letters >= 0xC0, self.letters.astype(np.int64) - 0xC0 + 26, self.letters.astype(np.int64) - ord("a"))
        flat = np.bincount((np.arange(len(words))[:, None] * LETTERS + index).ravel(), minlength=len(words) * LETTERS)
        # whole numbers below 2^24 are exact in 32 bits
        self.counts = flat.reshape(len(words), LETTERS).astype(np.float32 if self.letters.shape[1] < 2000 else np.float64)
        self.squares = (self.counts**2).sum(1)


def close(a: _Words, b: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose letter counts are within a squared distance of 2, by one matrix product."""
    return np.nonzero(a.squares[:, None] + b.squares[None, :] - 2 * (a.counts @ b.counts.T) <= 2)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of letters, ``a`` as long as ``b`` or one longer: whether one replaced, or one further, letter is all that differs."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    same_head = np.cumprod(a[:, :-1] == b, axis=1).sum(1)
    same_tail = np.cumprod((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return same_head + same_tail >= b.shape[1]


def _edits(a: _Words, b: _Words, itself: bool, pairs_at_once: int = 200_000):
    """Verified pairs of two lists (a list with itself: each once), in slices of a bounded size."""
    i, j = close(a, b)
    if itself:
        i, j = i[i < j], j[i < j]
    step = max(1, min(pairs_at_once, 20_000_000 // a.letters.shape[1]))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        good = one_edit(a.letters[x], b.letters[y]) if a.letters.shape[1] >= b.letters.shape[1] else one_edit(b.letters[y], a.letters[x])
        yield x[good], y[good]


def _pairs(stream):
    """For mapInArrow over rows sorted by block, its own words first: ``word, other, other_n`` of every near pair, both ways."""
    import pyarrow as pa

    at, own, done = None, None, None
    homes, guests = [], []

    def tell(a: _Words, b: _Words, itself: bool):
        for x, y in _edits(a, b, itself):
            if len(x):
                one, two = np.array(a.words, object)[x], np.array(b.words, object)[y]
                names = [w.decode("latin-1") for w in one], [w.decode("latin-1") for w in two]
                yield pa.RecordBatch.from_arrays([pa.array(names[0] + names[1]), pa.array(names[1] + names[0]), pa.array(np.concatenate([b.n[y], a.n[x]]))], ["word", "other", "other_n"])

    def settle():
        """The block's own words among themselves, once they are all there."""
        nonlocal own, homes
        if homes:
            own = [_Words([w for w, _ in homes[i : i + CHUNK]], [n for _, n in homes[i : i + CHUNK]]) for i in range(0, len(homes), CHUNK)]
            homes = []
            for i, a in enumerate(own):
                for j in range(i, len(own)):
                    yield from tell(a, own[j], i == j)

    def meet():
        nonlocal guests
        lengths: dict[int, list] = {}
        for w, n in guests:
            lengths.setdefault(len(w), []).append((w, n))
        guests = []
        for rows in lengths.values():
            b = _Words([w for w, _ in rows], [n for _, n in rows])
            for a in own or ():
                yield from tell(a, b, False)

    for batch in stream:
        for cell, part, guest, word, n in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "guest", "word", "n"))):
            if (cell, part) != at:
                yield from settle()
                yield from meet()
                at, own = (cell, part), None
            if guest:
                yield from settle()
                guests.append((word.encode("latin-1"), n))
                if len(guests) >= CHUNK:
                    yield from meet()
            else:
                homes.append((word.encode("latin-1"), n))
    yield from settle()
    yield from meet()


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other, other_n`` of all words exactly one edit apart; ``words`` is a written table ``word, n`` of letters a-z and U+00C0 to U+00FF."""
    rows = blocks(words)
    placed = rows.repartition(partitions(words.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "guest", "word")
    return placed.mapInArrow(_pairs, "word string, other string, other_n long")


def with_roots(forms: DataFrame, most: int) -> DataFrame:
    """Adds ``root``: where the forms lead to.  A form is at least twice as frequent, so there are few steps, and doubled steps need fewer rounds."""
    steps = max(1, int(most).bit_length())
    rounds = steps.bit_length()
    at = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        at = saved(at, "roots")
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = left_join_sized(at, next_, ["root"]).select("word", F.coalesce("_next", "root").alias("root"))
    return left_join_sized(forms, saved(at, "roots"), ["word"], salts=1).withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they are there; of equally frequent near words the first in code-point
    order is the form; a table without rows has no words; other columns are ignored.
    """
    words = saved(vocabulary(docs, least_letters, least_count, every), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w")))
    near = saved(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b")), "near")
    good = -F.col("b.n") >= ratio * F.col("n")
    rows = left_join_sized(words, near, ["word"], salts=1)
    forms = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("b.w")).alias("form"), F.when(good, -F.col("b.n")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    return with_roots(forms, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
