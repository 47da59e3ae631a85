"""Token counts of whole texts; huge texts are cut into overlapping chunks that resynchronise.

A pre-tokenizer scans from left to right and, once at a word boundary, goes on without regard to what stands before.
So where two overlapping chunks both have a word boundary at the same place, and the left chunk's boundary cannot
change with the text beyond that chunk's end, everything to its left may be counted in the left chunk and everything to its right in
the right chunk: the place is proven stable.  ``MARGIN`` characters before a chunk's end are not trusted: no match of
the pre-tokenizer looks further ahead, and no special string is longer.  Texts without such a place in an overlap go
round again with chunks and overlaps four times as wide, at last as one chunk.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import saved, slices, table

MARGIN = 32
#: Texts of more characters than this are cut.
HUGE = 16_384


def _count_short(path: str):
    def run(stream):
        import pyarrow as pa

        encoder = pieces.PieceEncoder.of(path)
        for batch in slices(stream):
            texts = batch.column("text").to_pylist()
            for a, b in pieces.batches(texts):
                n = [len(x) // encoder.dtype.itemsize for x in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "n_bytes")] + [pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def boundaries(encoded, shift: int) -> tuple[list[int], list[int]]:
    """Places (in the whole text) where a word begins, and how many of the chunk's tokens stand before each."""
    places, before, last = [], [], None
    words, offsets = encoded.word_ids, encoded.offsets
    for i, (word, (start, _)) in enumerate(zip(words, offsets)):
        if word is None or word != last:
            places.append(shift + start)
            before.append(i)
        last = word
    return places, before


def _encode_chunks(path: str):
    def run(stream):
        import pyarrow as pa

        tokenizer = pieces.load(path)
        fields = ["sha", "chunk", "n_chunks", "n", "left_at", "left_n", "right_at", "right_n"]
        lists = pa.list_(pa.int64())
        for batch in stream:
            rows = batch.to_pylist()
            out = {f: [] for f in fields}
            for r in rows:
                encoded = tokenizer.encode(r["part"], add_special_tokens=False)
                places, before = boundaries(encoded, r["begins"])
                # the overlap with the left neighbour, and that with the right one up to the margin
                j = bisect.bisect_right(places, r["begins"] + r["overlap"] - MARGIN)
                k = bisect.bisect_left(places, r["ends"] - r["overlap"])
                m = bisect.bisect_right(places, r["ends"] - MARGIN)
                first, last = r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1
                for f, v in zip(fields, (r["sha"], r["chunk"], r["n_chunks"], len(encoded.ids), [] if first else places[:j], [] if first else before[:j], [] if last else places[k:m], [] if last else before[k:m])):
                    out[f].append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), lists, lists, lists, lists]
            yield pa.RecordBatch.from_arrays([pa.array(out[f], k) for f, k in zip(fields, kinds)], fields)

    return run


_CHUNKS = "sha binary, chunk long, n_chunks long, begins long, ends long, overlap long, part string"


def _cut_chunks(chunk: int, overlap: int):
    """For mapInArrow: a row for each chunk of a text, cut by position while the text is held once; what goes out at a time is bounded."""

    def run(stream):
        import pyarrow as pa

        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        step = chunk - overlap
        for batch in stream:
            rows, held = [], 0
            for sha, text in zip(batch.column("sha"), batch.column("text")):
                sha, text = sha.as_py(), text.as_py()
                n = max(1, -(-(len(text) - overlap) // step))
                for i in range(n):
                    ends = min(len(text), i * step + chunk)
                    rows.append((sha, i, n, i * step, ends, overlap, text[i * step : ends]))
                    held += ends - i * step
                    if held >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def _seam(left_at, left_n, right_at, right_n):
    """In an overlap, the first common boundary: tokens of the left chunk before it, tokens of the right chunk before it."""
    common = F.array_min(F.array_intersect(left_at, right_at))
    return F.when(common.isNotNull(), F.struct(F.element_at(left_n, F.array_position(left_at, common).cast("int")).alias("a"), F.element_at(right_n, F.array_position(right_at, common).cast("int")).alias("b")))


def count_huge(texts: DataFrame, tokenizer: str, chunk: int = 8_192, overlap: int = 256) -> DataFrame:
    """``sha, n_tokens`` of texts (``sha, text``, one row for each text), by overlapping chunks."""
    spark = texts.sparkSession
    done = None
    todo = texts
    while True:
        cut = todo.select("sha", "text").mapInArrow(_cut_chunks(chunk, overlap), _CHUNKS)
        coded = saved(
            cut.repartition(F.col("sha"), F.col("chunk")).mapInArrow(
                _encode_chunks(tokenizer), "sha binary, chunk long, n_chunks long, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
            ),
            "chunks",
        )
        left = coded.select("sha", (F.col("chunk") + 1).alias("chunk"), F.col("right_at").alias("a_at"), F.col("right_n").alias("a_n"))
        seams = coded.filter("chunk > 0").join(left, ["sha", "chunk"]).select("sha", _seam(F.col("a_at"), F.col("a_n"), F.col("left_at"), F.col("left_n")).alias("seam"))
        # a chunk's tokens count from its left seam to its right seam: a text's total is the sum of n, plus (a - n_left) - b for each seam
        whole = coded.filter(F.col("chunk") == F.col("n_chunks") - 1).select("sha", F.col("n").alias("add"), F.lit(False).alias("lost"))
        parts = seams.select("sha", F.coalesce(F.col("seam.a") - F.col("seam.b"), F.lit(0)).alias("add"), F.col("seam").isNull().alias("lost"))
        got = saved(whole.unionByName(parts).groupBy("sha").agg(F.sum("add").cast("long").alias("n_tokens"), F.max("lost").alias("lost")), "seams")
        good = got.filter("not lost").select("sha", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = got.filter("lost").select("sha")
        if bad.isEmpty():
            return done
        todo = todo.join(bad, "sha", "left_semi")
        chunk, overlap = chunk * 4, overlap * 4


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, huge: int = HUGE, chunk: int = 8_192, overlap: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    Null and empty texts have no bytes and no tokens; repeated rows each give a row; null ids stay null; an empty table
    gives no rows; other columns are ignored.  Equal huge texts are encoded once.
    """
    if not (overlap > 2 * MARGIN and chunk >= 2 * overlap):
        raise ValueError("a chunk must hold two overlaps, an overlap two margins")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    small = rows.filter(F.char_length("text") <= huge).mapInArrow(_count_short(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    big = saved(rows.filter(F.char_length("text") > huge).withColumn("sha", F.unhex(F.sha2("text", 256))), "huge")
    texts = big.groupBy("sha").agg(F.first("text").alias("text"))
    counted = count_huge(texts, tokenizer, chunk, overlap)
    large = big.select("doc_id", "n_bytes", "sha").join(counted, "sha").select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
