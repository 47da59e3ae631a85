"""Token ids as binary shards: ids ranked by frequency, coded in whole bytes with separate control bytes.

Format.  A data set is a folder of shards and one ``ranks.bin``: the token ids (little-endian unsigned 32 bits) from the
most to the least frequent, so that a token's rank, not its id, is stored and frequent tokens take one byte.  A shard is
a row of blocks.  A block has a fixed head (magic, documents, ids, bytes of data), then for each document its id (8
bytes), whether it has one (1 byte) and its number of ids (8 bytes), then the control bytes, then the data bytes.  A control
byte holds the byte lengths less one of four ranks, two bits each, lowest first; the data are the ranks' little-endian
bytes without leading zeros.  The last control byte of a block is padded with ranks of 0.

Decoding is one numpy table lookup for each control byte: a table of 256 rows gives the bytes that it covers and where
the 16 bytes of its four 32-bit integers lie in them.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import partitions, saved, shared_dir

MAGIC = b"RKB1"
HEAD = "<4sQQQ"
BLOCK_IDS = 1 << 17
#: Pieces that a worker remembers: nothing else needs its memory meanwhile.
PIECES = 1_000_000

_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)  # of the four ranks of a control byte
_COVERS = _LENGTHS.sum(1)
_FROM = np.cumsum(_LENGTHS, 1) - _LENGTHS
#: Where each of 16 output bytes comes from; -1 for a leading zero.
_PLACES = np.where(np.arange(4) < _LENGTHS[:, :, None], _FROM[:, :, None] + np.arange(4), -1).reshape(256, 16).astype(np.int8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    length = 1 + (padded > 0xFF) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    quads = (length - 1).reshape(-1, 4).astype(np.uint8)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` ranks, by table lookup."""
    codes = np.frombuffer(control, np.uint8)
    covers = _COVERS[codes]
    begins = np.cumsum(covers) - covers
    places = _PLACES[codes]
    source = np.append(np.frombuffer(data, np.uint8), np.uint8(0))
    taken = source[np.where(places < 0, len(data), begins[:, None] + places)]
    return taken.astype(np.uint8).view("<u4").reshape(-1)[:count]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document; ids as little-endian bytes of the narrowest unsigned type of the vocabulary."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces.encode_rows(tokenizer, "text", ["doc_id"], end_id, PIECES), "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs in the whole table: counted in each task first, then summed; the result is as long as the vocabulary."""

    def count(stream):
        import pyarrow as pa

        pieces.forget()
        total = np.zeros(size, np.int64)
        for batch in stream:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def _shards(folder: str, dtype: np.dtype, size: int):
    """For mapInArrow over sorted rows: writes one shard for each partition, under a new name for each attempt, and tells of it."""

    def write(stream):
        import pyarrow as pa
        from pyspark import TaskContext

        pieces.forget()
        filesystem, base = _filesystem(folder)
        with filesystem.open_input_stream(f"{base}/ranks.bin", compression=None) as f:
            order = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(size, "<u4")
        rank[order] = np.arange(len(order))
        name, sink, totals = f"shard-{uuid.uuid4().hex}.bin", None, [0, 0]
        doc_ids, counts, parts, held = [], [], [], 0

        def flush():
            nonlocal held
            control, data = encode_ranks(rank[np.concatenate(parts)] if held else np.zeros(0, "<u4"))
            sink.write(struct.pack(HEAD, MAGIC, len(doc_ids), held, len(data)))
            sink.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], np.uint8).tobytes() + np.array(counts, "<u8").tobytes())
            sink.write(control)
            sink.write(data)
            totals[0] += len(doc_ids)
            totals[1] += held
            doc_ids.clear(), counts.clear(), parts.clear()
            held = 0

        for batch in stream:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                sink = sink or filesystem.open_output_stream(f"{base}/{name}", compression=None)
                ids = np.frombuffer(ids.as_buffer(), dtype)
                doc_ids.append(doc), counts.append(len(ids)), parts.append(ids.copy())
                held += len(ids)
                if held >= BLOCK_IDS:
                    flush()
        if sink:
            if doc_ids:
                flush()
            sink.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    return write


MANIFEST = "part long, file string, n_docs long, n_ids long"


def write_ids(tokens: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """Write tokenised documents in ascending ``doc_id`` order (nulls first, repeated ids by their ids' bytes) and return the manifest.

    ``tokens`` should be a written table: it is read to count, to find the ranges and to write.  The manifest, one row for
    each shard with its place in the order, is written as a table last: it names the files of successful attempts only.
    """
    dtype = pieces.id_type(vocabulary)
    counts = id_counts(tokens, dtype, vocabulary)
    order = np.argsort(-counts, kind="stable").astype("<u4")
    filesystem, base = _filesystem(folder)
    filesystem.create_dir(base, recursive=True)
    with filesystem.open_output_stream(f"{base}/ranks.bin", compression=None) as f:
        f.write(order.tobytes())
    spark = tokens.sparkSession
    placed = tokens.select("doc_id", "ids").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    placed.mapInArrow(_shards(folder, dtype, vocabulary), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32 bits) of every document, decoded from the shards; start: ids of all before it.

    ``digest``: the unsigned crc32 of the decoded ids (``ids_crc32``) in place of them.
    """
    last = ["ids_crc32", "long"] if digest else ["ids", "binary"]
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r.part)  # a row for each shard
    starts = np.cumsum([0] + [r.n_ids for r in shards]).tolist()
    listed = spark.createDataFrame([(r.file, s) for r, s in zip(shards, starts)], "file string, start long")

    def decode(stream):
        import pyarrow as pa

        pieces.forget()
        filesystem, base = _filesystem(folder)
        with filesystem.open_input_stream(f"{base}/ranks.bin", compression=None) as f:
            order = np.frombuffer(f.read(), "<u4")
        for batch in stream:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as f:
                    while head := f.read(struct.calcsize(HEAD)):
                        magic, n_docs, n_ids, n_data = struct.unpack(HEAD, head)
                        if magic != MAGIC:
                            raise ValueError(f"{name}: not a block of token ids")
                        docs = np.frombuffer(f.read(8 * n_docs), "<i8")
                        given = np.frombuffer(f.read(n_docs), np.uint8).astype(bool)
                        counts = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
                        control = f.read(-(-n_ids // 4))
                        data = order[decode_ranks(control, f.read(n_data), n_ids)].tobytes()
                        ends = np.cumsum(counts)
                        begins = ends - counts
                        ids = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                        told = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=~given), pa.array(start + begins), pa.array(counts), told], ["doc_id", "start", "n_tokens", last[0]])
                        start += n_ids

    return listed.repartition(max(1, len(shards))).mapInArrow(decode, f"doc_id long, start long, n_tokens long, {' '.join(last)}")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, folder: str | None = None, digest: bool = False) -> DataFrame:
    """Encode, write and read back.

    Null texts count as empty and still get the end id; null ids come first; repeated rows are kept, each as a document
    of its own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-ids")
    vocabulary = pieces.load(tokenizer).get_vocab_size()
    write_ids(saved(tokenise(docs, tokenizer, end_id), "tokens"), folder, vocabulary)
    return read_ids(spark, folder, digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
