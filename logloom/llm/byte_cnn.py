"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of eight bytes run over every place of a text.  The text is covered by overlapping chunks (each shares
its last seven bytes with the next, so every place lies in one chunk); a chunk keeps each filter's largest output; over the chunks
of a document the mean and the largest of these are combined into one probability.

Training uses a bounded sample of labelled rows: ``most_rows`` documents in hash order, of each up to ``most_chunks``
chunks spread over the whole text.  Scoring reads whole texts.  For scoring, filters become tables of byte pairs: four
lookups and sums give all filters' outputs at a place.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

WIDTH, FILTERS, CHUNK = 8, 16, 512
STEP = CHUNK - WIDTH + 1


def spread_chunks(data: bytes, most: int) -> list[bytes]:
    """Up to ``most`` chunks, spread evenly over the text."""
    starts = list(range(0, max(1, len(data) - WIDTH + 1), STEP))
    if len(starts) > most:
        starts = [starts[i * (len(starts) - 1) // (most - 1)] for i in range(most)]
    return [data[s : s + CHUNK].ljust(WIDTH, b"\0") for s in starts]


def features(chunks: list[np.ndarray], w: np.ndarray, b: np.ndarray):
    """Each filter's largest output in each chunk (positive part), and its place."""
    top, place = [], []
    for c in chunks:
        views = np.lib.stride_tricks.sliding_window_view(c, WIDTH)
        out = sum(w[k][views[:, k]] for k in range(WIDTH))
        at = out.argmax(0)
        top.append(out[at, np.arange(FILTERS)] + b)
        place.append(at)
    return np.maximum(np.array(top), 0), np.array(place)


class Model:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = {"w": (g.normal(0, 0.15, (WIDTH, 256, FILTERS))).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "u": g.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}

    def fit(self, docs: list[list[bytes]], labels: list[int], epochs: int = 8, rate: float = 0.01, size: int = 32, seed: int = 7) -> "Model":
        """Adam on the log loss; classes weigh the same; gradients go through the places of the largest outputs."""
        if not docs or len(set(labels)) < 2:
            self.p["u"][:] = 0
            self.p["c"][0] = 0.0 if not labels else (4.0 if labels[0] else -4.0)
            return self
        g, p, y = np.random.default_rng(seed), self.p, np.array(labels, float)
        data = [[np.frombuffer(c, np.uint8) for c in d] for d in docs]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        t = 0
        for epoch in range(epochs):
            order = g.permutation(len(data))
            for i in range(0, len(order), size):
                grad = {k: np.zeros_like(v) for k, v in p.items()}
                for d in order[i : i + size]:
                    top, place = features(data[d], p["w"], p["b"])
                    mean, best = top.mean(0), top.argmax(0)
                    x = np.concatenate([mean, top[best, np.arange(FILTERS)]])
                    z = float(x @ p["u"] + p["c"][0])
                    e = (1 / (1 + np.exp(-z)) - y[d]) * weight[d]
                    grad["u"] += e * x
                    grad["c"] += e
                    to_top = np.tile(e * p["u"][:FILTERS] / len(top), (len(top), 1))
                    to_top[best, np.arange(FILTERS)] += e * p["u"][FILTERS:]
                    to_top *= top > 0
                    grad["b"] += to_top.sum(0)
                    for c, at, d_top in zip(data[d], place, to_top):
                        for k in range(WIDTH):
                            np.add.at(grad["w"][k], (c[at + k], np.arange(FILTERS)), d_top)
                t += 1
                for k in p:
                    q = grad[k] / size
                    m[k] += 0.1 * (q - m[k])
                    s[k] += 0.001 * (q * q - s[k])
                    p[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def pairs(self) -> list[np.ndarray]:
        """For bytes at places 2k and 2k+1, read as one little-endian number, the sum of both filters' weights."""
        w = self.p["w"]
        return [(w[2 * k + 1][:, None, :] + w[2 * k][None, :, :]).reshape(65536, FILTERS) for k in range(WIDTH // 2)]

    def scores(self, texts: list[bytes], pairs: list[np.ndarray] | None = None, most: int = 1 << 17) -> np.ndarray:
        """Probabilities of label 1 for whole texts, a slice of places at a time; chunk maxima of a text meet in the end."""
        pairs = pairs or self.pairs()
        padded = [t.ljust(WIDTH, b"\0") for t in texts]
        counts = np.array([-(-(len(t) - WIDTH + 1) // STEP) for t in padded])
        chunks = [t[s : s + CHUNK] for t in padded for s in range(0, len(t) - WIDTH + 1, STEP)]
        tops = np.empty((len(chunks), FILTERS), np.float32)
        at = 0
        while at < len(chunks):
            end, size = at, 0
            while end < len(chunks) and size < most:
                size += len(chunks[end])
                end += 1
            flat = np.frombuffer(b"".join(chunks[at:end]) + b"\0" * WIDTH, np.uint8).astype(np.uint16)
            two = flat[:-1] | flat[1:] << 8
            out = pairs[0][two[:size]]
            for k in range(1, WIDTH // 2):
                out += pairs[k][two[2 * k : 2 * k + size]]
            sizes = np.array([len(c) for c in chunks[at:end]])
            ends = np.cumsum(sizes)
            begins = ends - sizes
            out[(ends[:, None] - np.arange(1, WIDTH)).reshape(-1)] = -np.inf
            tops[at:end] = np.maximum.reduceat(out, begins)
            at = end
        tops = np.maximum(tops + self.p["b"], 0)
        if not len(texts):
            return np.zeros(0)
        begins = np.cumsum(counts) - counts
        mean = np.add.reduceat(tops.astype(np.float64), begins) / counts[:, None]
        x = np.concatenate([mean, np.maximum.reduceat(tops, begins)], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.p["u"] + self.p["c"][0], -50, 50)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, most_chunks: int) -> tuple[list[list[bytes]], list[int]]:
    """A bounded sample: at most ``most_rows`` times ``most_chunks`` chunks come to the driver."""
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    # as many of either class, in hash order
    some = [ids.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2) for c in (0, 1)]
    chosen = some[0].unionByName(some[1]).dropDuplicates(["doc_id"])

    def cut(stream):
        import pyarrow as pa

        for batch in stream:
            chunks = [spread_chunks((t or "").encode("utf-8", "surrogatepass"), most_chunks) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(chunks, pa.list_(pa.binary()))], ["doc_id", "y", "chunks"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sorted(texts.select("doc_id", "y", "text").mapInArrow(cut, "doc_id long, y int, chunks array<binary>").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.chunks))
    return [[bytes(c) for c in r.chunks] for r in rows], [r.y for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row: null texts are empty, repeated rows are scored each, long ones in chunks, a null doc_id is not held out; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(stream):
        import pyarrow as pa

        pairs = model.pairs()
        for batch in slices(stream, 256):
            got = model.scores([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], pairs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = 1600, most_chunks: int = 6) -> DataFrame:
    """Train on labelled rows outside the held-out third and score every document; without labels of both classes the score is constant."""
    return score(docs, Model().fit(*training_rows(docs, labels, most_rows, most_chunks)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
