"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary built from records of that
archive; then each record is a frame of its own, so any record can be read alone with the dictionary.  Archives too small to
train a dictionary have none.  Records of equal payloads are written once: the others are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_sized, saved, shared_dir, table

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, n_records long, n_bytes long, dictionary_bytes long"


def plan_revisits(pages: DataFrame, least: int) -> DataFrame:
    """``_key, digest, refers_to`` of the pages that revisit: of equal payloads of at least ``least`` bytes the largest page_id answers for all.

    Only digests and ids move; groups are counted in each task first, so a payload with a third of all pages is one row
    for each task.
    """
    skinny = saved(pages.filter(F.octet_length("payload") >= least).select("page_id", "_key", "digest"), "digests")
    groups = skinny.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    joined = left_join_sized(skinny, saved(groups, "copies"), ["digest"])
    return joined.filter(F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))).select("_key", "digest", "refers_to").distinct()


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP head only, whose Content-Length tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def train(records: list[bytes], size: int, sample_bytes: int):
    """A dictionary from records spread evenly over the archive, ``sample_bytes`` of them at most; None if there is too little."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    samples = [r[i : i + (1 << 17)] for r in records[::step] for i in range(0, len(r), 1 << 17)]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 65_536, sample_bytes: int = 2_000_000) -> bytes:
    import zstandard

    dictionary = train(records, dictionary_bytes, sample_bytes)
    parts = []
    if dictionary is not None:
        raw = dictionary.as_bytes()
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        dictionary.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    else:
        packer = zstandard.ZstdCompressor(level=level)
    return b"".join(parts + [packer.compress(r) for r in records])


def dictionary_size(data: bytes) -> int:
    """Bytes of the dictionary in an archive's leading frame, 0 without one."""
    magic, size = struct.unpack("<II", data[:8])
    return size if magic == DICTIONARY_MAGIC else 0


def read_archive(stream):
    """The records of an open archive, as bytes, one after the other."""
    import zstandard

    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    pending, out, one = head, [], unpacker.decompressobj()
    fed = False
    while True:
        if not pending:
            pending = stream.read(1 << 16)
            if not pending:
                break
        out.append(one.decompress(pending))
        fed = True
        pending = b""
        if one.eof:
            pending = one.unused_data
            yield b"".join(out)
            out, one, fed = [], unpacker.decompressobj(), False
    if fed:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Fields of a record; the digest and size of a response are those of the payload that is there."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda name: int(x[10:-1]) if (x := fields.get(name)) and len(x) > 11 else None
    url = fields.get("WARC-Target-URI")
    url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": number("WARC-Record-ID"), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}


def _writer(folder: str, archive_bytes: int, date: str):
    def run(stream):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder)
        records, held, told = [], 0, []

        def flush():
            nonlocal records, held
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with filesystem.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            told.append((name, len(records), len(data), dictionary_size(data)))
            records, held = [], 0

        for batch in stream:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page_id, url, payload, digest, refers = (x.as_py() for x in r)
                records.append(record(page_id, url, payload, digest, refers, date))
                held += len(records[-1])
                if held >= archive_bytes:
                    flush()
        if records:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.int64()), pa.array([x[3] for x in told], pa.int64())], ["file", "n_records", "n_bytes", "dictionary_bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 48_000_000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as archives of about ``archive_bytes`` before compression and return the manifest, written last.

    A null html is an empty payload; a null url has no target; repeated rows are records of their own, and all copies
    with a group's largest page_id stay responses; a null page_id never answers for others; an empty table writes no
    archive; other columns are ignored.  Archives of failed attempts are not in the manifest.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    filesystem, base = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    revisits = saved(plan_revisits(rows, least), "revisits")
    planned = left_join_sized(rows, revisits, ["_key", "digest"])
    planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writer(folder, archive_bytes, date), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest; one archive is read as a stream in one task."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").filter("file is not null")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(stream):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in stream:
            for name in batch.column("file").to_pylist():
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for data in read_archive(f):
                        row = parse(data)
                        rows.append([row[n] for n in names])
                        held += len(data) if payloads else 300
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)

    spread = max(1, manifest.count())
    return manifest.select("file").repartition(spread).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM g
"""
