"""N-gram Jaccard join with set-relation skipping.

Documents with equal shingle sets are one node.  Two sets link when they have at least ``percent`` hundredths of their union in common, that is
when their distance (the size of the symmetric difference) is at most a share of the sum of their sizes.

* Answers of similar sets.  Sets that look alike by minhash are compared with a set that stands in the middle of many (a centre), once each.
  A set that links with its centre joins the centre's star and keeps its answer as a difference list: the shingles by which the two differ.
  From the centre's distance to a set z, that of every member follows by correcting for its difference list; z's text is not read again, nor the member's.
* Skipping in the lists.  The shingles of a set are ordered from rare to frequent; linked sets share one of their first shingles (the
  prefix).  A star has one row for each shingle in its members' prefixes, with the bounds of their positions and sizes.  Lists are sorted by size; long ones are
  skipped in blocks that know their sizes and positions.  Lists of one component are dropped.
* Pairs of stars that the lists leave open are bounded by the number of common shingles and by the parities of buckets (with a star's radius);
  what is still open is compared: centre with centre, and from that answer member with member.

No list, star or component is capped.  Frequencies and looks set only the order of work, which the result does not depend on.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, left_join_sized, partitions, saved, sized, slices, table, tidy
from .components import components
from .shingles import common, set_key, sets_of

SLOTS = 1 << 22
FREQUENT = 32
BLOCK = 64
#: Sizes of work: postings in a bucket of lists, members in a block of a star, pairs in a part.
POSTINGS, MEMBERS, PAIRS = 2_000_000, 1000, 500
BANDS, IN_BAND = 6, 2



def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """For each slot of a table of SLOTS bytes the bit length of the count of its most frequent shingle, 0 under FREQUENT.

    Shingles found at least twice in a few thousand texts are counted over all documents; each range of slots is made in one task.
    """
    spark = docs.sparkSession
    pieces = 64

    def count(stream):
        import pyarrow as pa

        for batch in slices(stream, 3000):
            found = [s for s in sets_of(batch.column("text").to_pylist(), k) if len(s)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    def fill(stream):
        import pyarrow as pa

        tables: dict[int, np.ndarray] = {}
        for batch in stream:
            at, level = batch.column("slot").to_numpy(), batch.column("level").to_numpy()
            for p in np.unique(at // (SLOTS // pieces)).tolist():
                mine = at // (SLOTS // pieces) == p
                np.maximum.at(tables.setdefault(p, np.zeros(SLOTS // pieces, np.uint8)), at[mine] % (SLOTS // pieces), level[mine].astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int64()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["piece", "levels"])

    counts = docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    levels = counts.select((F.col("shingle").bitwiseAND(F.lit(SLOTS - 1))).alias("slot"), F.length(F.bin("n")).cast("long").alias("level"))
    best = levels.groupBy("slot").agg(F.max("level").alias("level"))
    out = np.zeros(SLOTS, np.uint8)
    for row in best.repartition(min(pieces, partitions(spark)), F.floor(F.col("slot") / (SLOTS // pieces))).mapInArrow(fill, "piece long, levels binary").collect():
        lo = row.piece * (SLOTS // pieces)
        out[lo : lo + SLOTS // pieces] = np.maximum(out[lo : lo + SLOTS // pieces], np.frombuffer(row.levels, np.uint8))
    return out


def prefix_of(values: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order of (frequency level, hash) that a similar set must share one of."""
    n = len(values)
    length = n + (-percent * n) // 100 + 1
    level = levels[values & np.uint64(SLOTS - 1)]
    if level.any():
        key = level.astype(np.uint64) << np.uint64(58) | values >> np.uint64(6)
        return values[np.argsort(key, kind="stable")[:length]]
    return values[:length]


_HASHES = np.random.default_rng(11).integers(1, 1 << 63, BANDS * IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(values: np.ndarray) -> np.ndarray:
    """Minhashes, two to a band: sets of a similarity s share a band with a chance of s squared."""
    with np.errstate(over="ignore"):
        least = np.array([(values * m).min() for m in _HASHES]).reshape(BANDS, IN_BAND)
        return (least[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ least[:, 1]).view(np.int64)


def parities(values: np.ndarray) -> bytes:
    """A bit for each of so many buckets that two to four are there for each shingle: whether an odd number of shingles fall into it."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length())
    return np.packbits((np.bincount((values >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The least size of the symmetric difference of two sets with these parities: a bucket of differing parity holds one of it."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):  # the bucket is the low bits of a hash: halves fold onto each other
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _row_key(id_col: str, text_col: str):
    """A 128-bit name of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


SETS = "row long, row_key binary, doc_id long, set_key binary, n long, bands array<long>, parity binary, prefix binary"


def summarise(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A written table with one row (``SETS``) for each document; ``row`` numbers them, ``set_key`` is null without shingles."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    levels = spark.sparkContext.broadcast(frequency_levels(docs.select(text), k))

    def run(stream):
        import pyarrow as pa

        names = [c.split()[0] for c in SETS.split(", ")]
        for batch in slices(stream):
            sets = list(sets_of(batch.column("text").to_pylist(), k))
            made = [
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands_of(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([parities(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([prefix_of(s, levels.value, percent).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + made, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), _row_key(id_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), text)
    return saved(rows.mapInArrow(run, SETS), "sets")


def _needed(n1, n2, percent):
    """The least overlap of sets of these sizes at the threshold."""
    return -(-percent * (n1 + n2) // (100 + percent))


# -- stars ---------------------------------------------------------------------------------------------------------


def look_alikes(nodes: DataFrame) -> DataFrame:
    """``place, value, node, weight``: the bands of each set that another one has too; ``weight``: how many have its bands, all of them together.

    Of many that look alike the one with most weight stands in their middle: it has the bands that most of them have.
    """
    bands = nodes.select("node", F.posexplode("bands").alias("place", "value"))
    shared = saved(bands.groupBy("place", "value").agg(F.count("*").alias("k")).filter("k > 1"), "bands")
    alike = saved(left_join_sized(bands, shared, ["place", "value"]).filter("k is not null"), "alike")
    weights = saved(alike.groupBy("node").agg(F.sum("k").alias("weight")), "weights")
    return saved(left_join_sized(alike.drop("k"), weights, ["node"], salts=1).select("place", "value", "node", "weight"), "alike")


#: Distance, in thousandths of the size, of sets that were not held against a set away from the middle.
NOT_NEAR = 1 << 20


def proposals(alike: DataFrame, starred: DataFrame | None, labels: DataFrame | None, tried: DataFrame | None, near: DataFrame | None = None) -> DataFrame:
    """``a, b``: for each star b at most one star a of another component, that with most members in the bands that they share.

    Of equal ones it is the one that is nearest to a set that most others were too far from (``near``: ``node, d``), then the one with most weight.
    """
    if near is not None:
        alike = left_join_sized(alike, near, ["node"], salts=1).withColumn("weight", F.struct(-F.coalesce("d", F.lit(NOT_NEAR)), "weight")).drop("d")
    if starred is None:
        seen = alike.select("place", "value", F.col("node").alias("star"), F.lit(1).alias("size"), "weight")
    else:
        named = left_join_sized(alike, starred.select("node", "star"), ["node"], salts=1).withColumn("star", F.coalesce("star", "node"))
        seen = saved(named.groupBy("place", "value", "star").agg(F.count("*").alias("size"), F.max("weight").alias("weight")), "seen")
    top = seen.groupBy("place", "value").agg(F.max(F.struct("size", "weight", F.xxhash64("star").alias("turn"), F.col("star").alias("lead"))).alias("top"), F.count("*").alias("k"))
    top = saved(top.filter("k > 1").select("place", "value", F.col("top.lead").alias("a")), "top")
    pairs = left_join_sized(seen.withColumnRenamed("star", "b"), top, ["place", "value"]).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("agree"))
    if labels is not None:
        for x in ("a", "b"):
            pairs = left_join_sized(pairs, labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), [x])
        pairs = pairs.filter("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b", "agree")
    if tried is not None:
        pairs = pairs.join(sized(tried.select("a", "b")), ["a", "b"], "left_anti")
    best = pairs.groupBy("b").agg(F.max(F.struct("agree", F.xxhash64("a").alias("turn"), "a")).alias("best"))
    return saved(best.select("best.a", "b"), "pairs")


def _compare(percent: int, k: int):
    """Sorted rows: a centre's text, then those to compare with it, then the next centre's."""

    def run(stream):
        import pyarrow as pa

        centre, mine, last = None, None, None
        for batch in slices(stream):
            out = []
            for a, part, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), sets_of(batch.column("text").to_pylist(), k)):
                if b is None:
                    centre, mine, last = (a, part), s, None
                elif centre != (a, part):
                    raise ValueError("a pair without its centre's text")
                elif b != last:
                    last, both = b, common(mine, s)
                    link = 100 * both >= percent * (len(mine) + len(s) - both)
                    out.append((a, b, len(s), len(mine) + len(s) - 2 * both, link, np.setxor1d(mine, s, True).tobytes() if link else None))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "n", "d", "link", "diff"])

    return run


def texts_of(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, in a written table; wholly equal rows may give a node twice."""
    keys = saved(left_join_sized(nodes.select("node", "row_key"), wanted.select("node", F.lit(True).alias("asked")), ["node"], salts=1).filter("asked").select("node", "row_key"), "wanted")
    rows = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return saved(rows.join(sized(keys), "row_key").select("node", "text"), "texts")


@tidy
def compare(texts: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """``a, b, n, d, link, diff``: size of b, distance, and of linked sets the difference list.  A centre's text goes once to each part of its pairs."""
    n = partitions(texts.sparkSession)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    split = saved(pairs.join(sized(saved(parts, "parts")), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).select("a", "b", "part"), "split")
    heads = saved(split.select("a", "part").distinct(), "heads")
    members = texts.withColumnRenamed("node", "b").join(sized(split), "b").select("a", "part", "b", "text")
    centres = texts.withColumnRenamed("node", "a").join(sized(heads), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    together = members.unionByName(centres).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return together.mapInArrow(_compare(percent, k), "a long, b long, n long, d long, link boolean, diff binary")


def make_stars(nodes: DataFrame, texts_for, percent: int, k: int, turns: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """``starred`` (node, star, n, d, diff: sets that joined a star), ``edges`` between stars that are one component, and ``labels`` of stars.

    Turns only find more of the links early; the lists find the rest.  In the first two a set that stands at the rim of its look-alikes, most of which are
    too far from it, gets no star: its distance to another is that of both from the middle together, so the nearest of them comes next.
    """
    alike = look_alikes(nodes)
    texts = texts_for(saved(alike.select("node").distinct(), "involved"))
    starred = labels = tried = near = None
    for turn in range(turns):
        pairs = proposals(alike, starred, labels, tried, near)
        if pairs.isEmpty():
            break
        found = compare(texts, pairs, percent, k)
        near = None
        if turn < min(2, turns - 1):
            rim = found.groupBy("a").agg(F.count("*").alias("asked"), F.count_if("link").alias("links")).filter("asked >= 4 and 4 * links < 3 * asked").select("a", F.lit(True).alias("rim"))
            if starred is not None:
                rim = rim.join(sized(saved(starred.select(F.col("star").alias("a")).distinct(), "stars")), "a", "left_anti")
            found = saved(left_join_sized(found, saved(rim, "rim"), ["a"]), "found")
            near = saved(found.filter("rim").groupBy(F.col("b").alias("node")).agg(F.min(F.floor(1000 * F.col("d") / F.col("n"))).alias("d")), "near")
            found = found.withColumn("link", F.col("link") & F.col("rim").isNull()).drop("rim")
        tried = found if tried is None else tried.unionByName(found)
        joined = found.filter("link").select(F.col("b").alias("node"), F.col("a").alias("star"), "n", "d", "diff")
        if starred is not None:  # a star with members stays one
            joined = joined.join(sized(saved(starred.select(F.col("star").alias("node")).distinct(), "stars")), "node", "left_anti")
        joined = saved(joined, "joined")
        starred = joined if starred is None else starred.unionByName(joined)
        centres = saved(starred.select(F.col("star").alias("b")).distinct(), "centres")
        edges = saved(tried.filter("link").select("a", "b").join(sized(centres), "b", "left_semi"), "links")
        labels = components(edges)
    return starred, (None if starred is None else edges), labels


# -- lists ---------------------------------------------------------------------------------------------------------


def _unions(stream):
    """Rows of one part of a star, sorted by it: one row with each shingle of their prefixes, the last of its places and the most that may follow it."""
    import pyarrow as pa

    def told(key, rows):
        values = np.concatenate([p for _, p in rows])
        at = np.concatenate([np.arange(len(p)) for _, p in rows])
        left = np.concatenate([n - np.arange(len(p)) for n, p in rows])
        order = np.argsort(values, kind="stable")
        found, first = np.unique(values[order], return_index=True)
        sizes = [n for n, _ in rows]
        binary = [found.tobytes(), np.maximum.reduceat(at[order], first).astype("<u4").tobytes(), np.maximum.reduceat(left[order], first).astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([key[0], key[1], min(sizes), max(sizes), *binary], [pa.int64()] * 4 + [pa.binary()] * 3)], ["star", "label", "lo", "hi", "shingles", "at", "left"])

    key, rows = None, []
    for batch in slices(stream):
        for star, label, part, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("star", "label", "part", "n", "prefix"))):
            if rows and key != (star, label, part):
                yield told(key, rows)
                rows = []
            key = (star, label, part)
            rows.append((n, np.frombuffer(prefix, np.uint64)))
    if rows:
        yield told(key, rows)


FIELDS = ("shingle", "star", "label", "lo", "hi", "at", "left", "single")
BLOCKS = "bucket long, data binary"


def _narrow(x: np.ndarray) -> bytes:
    """A byte with the width, then the numbers."""
    width = 2 if not len(x) or x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", count, at + 1).astype(np.int64), at + 1 + width * count


def _packed(x: dict[str, np.ndarray], bucket: np.ndarray):
    """Postings in blocks, one for each bucket: the stars of a block once, then for each posting its shingle, star, place and rest."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    data = []
    for i, j in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
        mine = order[i:j]
        stars, at, index = np.unique(x["star"][mine], return_index=True, return_inverse=True)
        of = {c: x[c][mine[at]] for c in ("label", "lo", "hi", "single")}
        left = x["left"][mine]
        plain = bool((left == x["lo"][mine] - x["at"][mine]).all())
        block = struct.pack("<?II", plain, len(stars), len(mine)) + stars.astype("<i8").tobytes() + of["label"].astype("<i8").tobytes() + of["lo"].astype("<u4").tobytes() + of["hi"].astype("<u4").tobytes() + of["single"].astype("<u1").tobytes()
        data.append(block + x["shingle"][mine].tobytes() + _narrow(index.reshape(-1)) + _narrow(x["at"][mine]) + (b"" if plain else _narrow(left)))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "data"])


def _unpacked(blocks: list[bytes]) -> dict[str, np.ndarray]:
    got: dict[str, list] = {c: [] for c in FIELDS}
    for data in blocks:
        plain, k, m = struct.unpack_from("<?II", data)
        i = struct.calcsize("<?II")
        of = {}
        for c, kind in (("star", "<i8"), ("label", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("single", "<u1")):
            of[c] = np.frombuffer(data, kind, k, i)
            i += of[c].nbytes
        values = np.frombuffer(data, "<u8", m, i)
        index, i = _wide(data, i + 8 * m, m)
        at, i = _wide(data, i, m)
        lo = of["lo"][index].astype(np.int32)
        left = lo - at if plain else _wide(data, i, m)[0]
        for c, v in zip(FIELDS, (values, of["star"][index], of["label"][index], lo, of["hi"][index].astype(np.int32), at.astype(np.int32), left.astype(np.int32), of["single"][index].astype(bool))):
            got[c].append(v)
    return {c: np.concatenate(v) for c, v in got.items()}


def _by_shingle(x: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    return (x["shingle"] >> np.uint64(20)) % np.uint64(buckets)


def _by_star(x: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x["star"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)


def _blocks(buckets: int, most: int = 400_000):
    """Postings of rows (``star, label, lo, hi`` and a prefix, or shingles with places and rests) in packed blocks, by bucket of the shingle."""

    def flush(held):
        x = {c: np.repeat(np.array([r[i] for r in held], np.int64), [len(r[4]) for r in held]) for i, c in enumerate(("star", "label", "lo", "hi"))}
        x |= {"shingle": np.concatenate([r[4] for r in held]), "at": np.concatenate([r[5] for r in held])}
        single = held[0][6] is None
        x["left"] = x["lo"] - x["at"] if single else np.concatenate([r[6] for r in held])
        x["single"] = np.full(len(x["at"]), single)
        return _packed(x, _by_shingle(x, buckets))

    def run(stream):
        held, size = [], 0
        for batch in slices(stream):
            single = "at" not in batch.schema.names
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                values = np.frombuffer(row[4], np.uint64)
                if single:
                    held.append((*row[:4], values, np.arange(len(values)), None))
                else:
                    held.append((*row[:4], values, *(np.frombuffer(x, "<u4").astype(np.int64) for x in row[5:])))
                size += len(values)
                if size >= most:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _each_bucket(make):
    """For mapInArrow over blocks sorted by bucket: what ``make`` gives for the postings of each bucket."""

    def run(stream):
        bucket, blocks = None, []
        for batch in slices(stream):
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if blocks and b != bucket:
                    yield from make(_unpacked(blocks))
                    blocks = []
                bucket = b
                blocks.append(data)
        if blocks:
            yield from make(_unpacked(blocks))

    return run


def _shared_postings(buckets: int):
    """Of each list those that more than one component shares, by star."""

    def make(x):
        x, ends = _mixed_lists(x)
        if len(ends):
            yield _packed(x, _by_star(x, buckets))

    return make


def _ranked(percent: int, buckets: int):
    """Places of a single set's postings among those that another component has too: what only it has can be common with no other.

    So much less may be common before a posting and behind it; behind the prefix anything may be.
    """

    def make(x):
        order = np.lexsort((x["at"], x["star"]))
        x = {c: v[order] for c, v in x.items()}
        first = np.flatnonzero(np.concatenate([[True], x["star"][1:] != x["star"][:-1]]))
        sizes = np.diff(np.append(first, len(order)))
        rank = np.arange(len(order)) - np.repeat(first, sizes)
        behind = -(-percent * x["lo"].astype(np.int64) // 100) - 1
        x["at"] = np.where(x["single"], rank, x["at"])
        x["left"] = np.where(x["single"], np.repeat(sizes, sizes) - rank + behind, x["left"])
        yield _packed(x, _by_shingle(x, buckets))

    return make


def _mixed_lists(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The lists of at least two components, each sorted by size, and where each ends."""
    order = np.argsort(x["shingle"])
    s = x["shingle"][order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((x["lo"][order], x["shingle"][order]))]
    s, label = x["shingle"][order], x["label"][order]
    if not len(s):
        return x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    sizes = np.diff(np.append(first, len(s)))
    order = order[np.repeat(mixed, sizes)]
    return {c: v[order] for c, v in x.items()}, np.cumsum(sizes[mixed])


def _crossings(percent: int, with_stars: bool = False):
    """Of each list the pairs of different components that sizes and positions allow; ``with_stars``: only those of which one is a star.

    A common shingle at these positions has at most as many common ones before it as the lower position, and from it on as the shorter rest.  ``rest`` is
    what may be common behind it.  Stars count with the bounds of their members.
    """

    def allowed(x, i, j):
        """Which pairs may link (i has the lesser lower size), the overlap they need and what may follow."""
        lo_i, lo_j = x["lo"][i].astype(np.int64), x["lo"][j].astype(np.int64)
        least = np.maximum(lo_i, -(-percent * lo_j // 100))
        need = _needed(least, lo_j, percent)
        rest = np.minimum(x["left"][i], x["left"][j])
        ok = (least <= x["hi"][i]) & (x["label"][i] != x["label"][j]) & (np.minimum(x["at"][i], x["at"][j]) + rest >= need)
        if with_stars:
            ok &= ~(x["single"][i] & x["single"][j])
        return ok, need, rest

    def pairs(x, ends):
        sizes = np.diff(np.concatenate([[0], ends]))
        end = np.repeat(ends, sizes)
        short = np.repeat(sizes <= 4 * BLOCK, sizes)
        i, step = np.flatnonzero(short), 1
        while len(i):  # neighbours at one step after the other, of all short lists at once
            i = i[i + step < end[i]]
            i = i[percent * x["lo"][i + step].astype(np.int64) <= 100 * x["hi"][i].astype(np.int64)]
            ok, need, rest = allowed(x, i, i + step)
            if ok.any():
                yield i[ok], i[ok] + step, need[ok], rest[ok]
            step += 1
        for a, b in zip((ends - sizes)[sizes > 4 * BLOCK].tolist(), ends[sizes > 4 * BLOCK].tolist()):
            starts = np.arange(a, b, BLOCK)
            far, top = np.maximum.reduceat(x["at"][a:b], starts - a), np.maximum.reduceat(x["left"][a:b], starts - a)
            low = x["lo"][starts].astype(np.int64)
            for i in range(a, b - 1):
                least = np.maximum(int(x["lo"][i]), -(-percent * low // 100))
                reach = np.minimum(x["at"][i], far) + np.minimum(x["left"][i], top) >= _needed(least, low, percent)
                reach &= (least <= x["hi"][i]) & (np.append(starts[1:], b) > i + 1)
                reach[(i - a) // BLOCK] = True  # its own block begins before it
                blocks = np.flatnonzero(reach)
                blocks = blocks[blocks >= (i - a) // BLOCK]
                j = (starts[blocks][:, None] + np.arange(BLOCK)).ravel()
                j = j[(j > i) & (j < b)]
                ok, need, rest = allowed(x, np.full(len(j), i), j)
                if ok.any():
                    yield np.full(int(ok.sum()), i), j[ok], need[ok], rest[ok]

    def told(x, found):
        """Rows of one star with many of its partners, packed; a pair that several lists of the bucket hold is one entry."""
        import pyarrow as pa

        i, j, need, rest = (np.concatenate(c) for c in zip(*found))
        a, b = x["star"][i], x["star"][j]
        entries = _summed(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), rest.astype(np.int64) - 1, rest.astype(np.int64) - 1, need, x["single"][i] & x["single"][j])
        with np.errstate(over="ignore"):
            slot = ((entries[1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOT
        order = np.lexsort((slot, entries[0]))
        entries, slot = [e[order] for e in entries], slot[order]
        first = np.flatnonzero(np.concatenate([[True], (entries[0][1:] != entries[0][:-1]) | (slot[1:] != slot[:-1])]))
        data = [b"".join(e[p:q].astype(t).tobytes() for e, t in zip(entries[1:], _ENTRY)) for p, q in zip(first.tolist(), np.append(first[1:], len(slot)).tolist())]
        return pa.RecordBatch.from_arrays([pa.array(entries[0][first]), pa.array(slot[first]), pa.array(data, pa.binary())], ["a", "slot", "data"])

    def make(x):
        x, ends = _mixed_lists(x)
        found, size = [], 0
        for p in pairs(x, ends) if len(ends) else ():
            found.append(p)
            size += len(p[0])
            if size > 200_000:
                yield told(x, found)
                found, size = [], 0
        if found:
            yield told(x, found)

    return make


#: Parts of a star's partners, and what is told of each: partner, common shingles, least and most that may follow, need, whether both are single sets.
SLOT = 8
_ENTRY = ("<i8", "<i4", "<i4", "<i4", "<i4", "<i1")


def _summed(a, b, seen, least, most, need, single) -> list[np.ndarray]:
    """Entries of the same pair together."""
    order = np.lexsort((b, a))
    a, b, seen, least, most, need, single = (v[order] for v in (a, b, seen, least, most, need, single))
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return [a[first], b[first], np.add.reduceat(seen, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.minimum.reduceat(need, first), single[first]]


def _by_count(stream):
    """Pairs whose common shingles in the lists and what may follow the last of them reach the needed overlap; rows sorted by star and slot."""
    import pyarrow as pa

    def opened(key, parts):
        count = [len(d) // 25 for d in parts]
        columns = [[] for _ in _ENTRY]
        for d, n in zip(parts, count):
            at = 0
            for c, t in zip(columns, _ENTRY):
                c.append(np.frombuffer(d, t, n, at).astype(np.int64))
                at += c[-1].size * np.dtype(t).itemsize
        b, *rest = (np.concatenate(c) for c in columns)
        a, b, seen, least, most, need, single = _summed(np.full(len(b), key[0]), b, *rest)
        ok = seen + np.where(single == 1, least, most) >= need
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    key, parts = None, []
    for batch in slices(stream, 10_000):
        for a, slot, data in zip(*(batch.column(c).to_pylist() for c in ("a", "slot", "data"))):
            if parts and key != (a, slot):
                yield opened(key, parts)
                parts = []
            key = (a, slot)
            parts.append(data)
    if parts:
        yield opened(key, parts)


def candidates(prefixes: DataFrame, starred: DataFrame | None, labels: DataFrame | None, percent: int, part: str = "all") -> DataFrame:
    """``a, b``: pairs of stars of different components whose prefixes leave it open whether some of their members link.

    ``part``: all, those of which one has members (``stars``), or those of two single sets (``singles``).  Near copies that no centre holds mostly link with some member of a star: once these links
    are known, what is left of the pairs between such copies does not grow with the square of their number.
    """
    spark = prefixes.sparkSession
    n = partitions(spark)
    if starred is None:
        alone, grouped = prefixes.select(F.col("node").alias("star"), F.col("node").alias("label"), F.col("n").alias("lo"), F.col("n").alias("hi"), "prefix"), None
    else:
        sizes = saved(starred.groupBy("star").agg(F.ceil((F.count("*") + 1) / MEMBERS).cast("int").alias("parts")), "sizes")
        places = starred.select("node", "star").unionByName(sizes.select(F.col("star").alias("node"), "star"))
        places = left_join_sized(left_join_sized(places, sizes, ["star"]), labels.select(F.col("node").alias("star"), "label"), ["star"]).withColumn("label", F.coalesce("label", "star"))
        placed = left_join_sized(prefixes, saved(places, "places"), ["node"], salts=1)
        alone = left_join_sized(placed.filter("star is null").select("node", "n", "prefix"), labels.select("node", F.col("label").alias("known")), ["node"], salts=1)
        alone = alone.select(F.col("node").alias("star"), F.coalesce("known", "node").alias("label"), F.col("n").alias("lo"), F.col("n").alias("hi"), "prefix")
        piece = F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")
        rows = placed.filter("star is not null").select("star", "label", piece, "n", "prefix").repartition(n, "star", "part").sortWithinPartitions("star", "part")
        grouped = rows.mapInArrow(_unions, "star long, label long, lo long, hi long, shingles binary, at binary, left binary")
    postings = prefixes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(n, -(-int(postings) // POSTINGS))
    blocks = alone.mapInArrow(_blocks(buckets), BLOCKS)
    if grouped is not None and part != "singles":
        blocks = blocks.unionByName(grouped.mapInArrow(_blocks(buckets), BLOCKS))
    dealt = lambda rows: rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    shared = dealt(blocks).mapInArrow(_each_bucket(_shared_postings(buckets)), BLOCKS)
    ranked = dealt(shared).mapInArrow(_each_bucket(_ranked(percent, buckets)), BLOCKS)
    crossing = dealt(ranked).mapInArrow(_each_bucket(_crossings(percent, part == "stars")), "a long, slot long, data binary")
    return saved(crossing.repartition(n, "a", "slot").sortWithinPartitions("a", "slot").mapInArrow(_by_count, "a long, b long"), "counted")


def open_pairs(pairs: DataFrame, sets: DataFrame, stars: DataFrame | None, percent: int) -> DataFrame:
    """``a, b, blocks`` of pairs that parities and radii leave open; a has the more members, ``blocks`` parts of them.

    Sorted like texts for a comparison: a centre's facts once for each part of its pairs, then those of its partners.
    """
    spark = pairs.sparkSession
    asked = saved(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct().withColumn("asked", F.lit(True)), "asked")
    known = left_join_sized(sets.select("row", "n", "parity"), asked, ["row"], salts=1).filter("asked").select(F.col("row").alias("star"), "n", "parity")
    if stars is not None:
        known = left_join_sized(known, stars, ["star"], salts=1)
    else:
        known = known.withColumns({"radius": F.lit(None).cast("long"), "hi": F.lit(None).cast("long"), "members": F.lit(None).cast("long")})
    told = saved(known.select("star", "parity", F.coalesce("radius", F.lit(0)).cast("long").alias("r"), F.greatest("n", "hi").alias("hi"), F.coalesce("members", F.lit(0)).cast("long").alias("m")), "known")
    parts = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")), "parts")
    split = saved(left_join_sized(pairs, parts, ["a"]).withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).select("a", "b", "part"), "split")
    facts = ["parity", "r", "hi", "m"]
    centres = told.withColumnRenamed("star", "a").join(sized(saved(split.select("a", "part").distinct(), "heads")), "a").select("a", "part", F.lit(None).cast("long").alias("b"), *facts)
    partners = told.withColumnRenamed("star", "b").join(sized(split), "b").select("a", "part", "b", *facts)

    def run(stream):
        import pyarrow as pa

        key = mine = None
        for batch in slices(stream, 10_000):
            out = []
            for a, part, b, *other in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", *facts))):
                if b is None:
                    key, mine = (a, part), other
                    continue
                if key != (a, part):
                    raise ValueError("a pair without its centre")
                (x, r_a, hi_a, m_a), (y, r_b, hi_b, m_b) = mine, other
                if (100 + percent) * (apart(x, y) - r_a - r_b) <= (100 - percent) * (hi_a + hi_b):
                    out.append((b, a, 1 + m_b // MEMBERS) if m_b > m_a else (a, b, 1 + m_a // MEMBERS))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "blocks"])

    together = partners.unionByName(centres).repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return saved(together.mapInArrow(run, "a long, b long, blocks long"), "open")


def _decide(percent: int, k: int):
    """Sorted rows: the text of a centre, difference lists of a block of its members, then other centres' texts, each with its members' lists.

    Gives the pairs of centres of which some members link.  With the centres' difference E, members with lists Y and Z are |Y ^ Z ^ E| apart (^: the
    symmetric difference), so a block is answered by looking its lists up in Z ^ E.
    """

    def run(stream):
        import pyarrow as pa

        key = centre = lists = sizes = flat = last = None
        between, linked = None, False

        def links(apart: np.ndarray, n: int) -> bool:
            nonlocal flat
            if flat is None:
                lengths = np.array([len(x) for x in lists])
                flat = np.concatenate(lists), np.concatenate([[0], np.cumsum(lengths)]), lengths, np.array(sizes)
            values, ends, lengths, n_each = flat
            if (100 + percent) * (len(apart) - lengths.max()) > (100 - percent) * (n_each.max() + n):
                return False
            hit = np.zeros(len(values) + 1, np.int64)
            if len(apart) and len(values):
                place = np.searchsorted(apart, values)
                place[place == len(apart)] = 0
                np.cumsum(apart[place] == values, out=hit[1:])
            distance = lengths + len(apart) - 2 * (hit[ends[1:]] - hit[ends[:-1]])
            return bool(((100 + percent) * distance <= (100 - percent) * (n_each + n)).any())

        for batch in slices(stream):
            found = []
            kinds, data = batch.column("kind").to_pylist(), batch.column("data").to_pylist()
            sets = sets_of([d if kind in (0, 2) else b"" for kind, d in zip(kinds, data)], k)
            for a, block, part, kind, b, n, d, s in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "part", "kind", "b", "n")), data, sets):
                if kind == 0:
                    key, centre, lists, sizes, flat, last = (a, block, part), s, [np.zeros(0, np.uint64)], [len(s)], None, None
                    continue
                if key != (a, block, part):
                    raise ValueError("a pair without its centre's text")
                if kind == 1:
                    lists.append(np.frombuffer(d, np.uint64))
                    sizes.append(n)
                elif kind == 2:
                    if b != last:
                        last, between = b, np.setxor1d(centre, s, True)
                        linked = links(between, len(s))
                        if linked:
                            found.append((a, b))
                elif b != last:
                    raise ValueError("a member without its centre's text")
                elif not linked:
                    linked = links(np.setxor1d(between, np.frombuffer(d, np.uint64), True), n)
                    if linked:
                        found.append((a, b))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


@tidy
def decide(texts: DataFrame, pairs: DataFrame, starred: DataFrame | None, percent: int, k: int) -> DataFrame:
    """The pairs of stars (``a, b``) of which some members link.  Members of a come in blocks, its partners in parts, so that no star is hot."""
    n = partitions(texts.sparkSession)
    parts = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"), F.max("blocks").alias("blocks")), "parts")
    split = pairs.join(sized(parts.select("a", "parts")), "a").withColumn("part", F.pmod(F.xxhash64("b", "a"), "parts").cast("int"))
    split = saved(split.select("a", "b", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "split")
    heads = saved(split.select("a", "block", "part").distinct(), "heads")
    none = lambda t: F.lit(None).cast(t)
    text = F.encode("text", "utf-8").alias("data")
    rows = texts.withColumnRenamed("node", "a").join(sized(heads), "a").select("a", "block", "part", F.lit(0).alias("kind"), none("long").alias("b"), none("long").alias("n"), text)
    rows = rows.unionByName(texts.withColumnRenamed("node", "b").join(sized(split), "b").select("a", "block", "part", F.lit(2).alias("kind"), "b", none("long").alias("n"), text))
    if starred is not None:
        lists = starred.join(sized(parts.withColumnRenamed("a", "star")), "star").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        rows = rows.unionByName(lists.withColumnRenamed("star", "a").join(sized(heads), ["a", "block"]).select("a", "block", "part", F.lit(1).alias("kind"), none("long").alias("b"), "n", F.col("diff").alias("data")))
        rows = rows.unionByName(starred.withColumnRenamed("star", "b").join(sized(split), "b").select("a", "block", "part", F.lit(3).alias("kind"), "b", "n", F.col("diff").alias("data")))
    # a member's list follows its centre's text: both have a kind over 1, the text the lower
    together = rows.repartition(n, "a", "block", "part").sortWithinPartitions("a", "block", "part", F.least("kind", F.lit(2)), F.col("b").asc_nulls_first(), "kind")
    return together.mapInArrow(_decide(percent, k), "a long, b long").distinct()


# -- the operator --------------------------------------------------------------------------------------------------


@tidy
def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, turns: int = 4) -> DataFrame:
    """``doc_id, row_key, n_shingles, label, component_id`` of every row.

    Rows link when their shingle sets have a Jaccard similarity of at least ``percent`` hundredths; ``component_id`` is the smallest id that links
    reach, ``label`` names components of two rows and more (null: a row alone).  Null, empty and blank texts have no shingles and link with nothing;
    texts of fewer than ``k`` words are one shingle; very long texts are hashed in parts; repeated rows share a set; null ids count as no id, and a
    component of null ids alone has none; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    sets = summarise(docs, id_col, text_col, k, percent)
    groups = saved(sets.filter("n > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "groups")
    copies = saved(groups.filter("copies > 1").select("set_key", "node"), "copies")
    one_each = lambda *columns: left_join_sized(sets.filter("n > 0").select("row", "set_key", *columns), copies, ["set_key"]).filter("node is null or node = row").drop("node").withColumnRenamed("row", "node")
    nodes = saved(one_each("row_key", "bands").drop("set_key"), "nodes")
    texts_for = lambda wanted: texts_of(docs, id_col, text_col, nodes, wanted)
    starred, edges, labels = make_stars(nodes, texts_for, percent, k, turns)
    stars = None
    if starred is not None:
        stars = saved(starred.groupBy("star").agg(F.max("d").alias("radius"), F.max("n").alias("hi"), F.count("*").alias("members")), "stars")
    for part in ("all",) if starred is None else ("stars", "singles"):
        members, facts = (starred, stars) if part == "stars" else (None, None)
        pairs = open_pairs(candidates(one_each("n", "prefix").drop("set_key"), starred, labels, percent, part), sets, facts, percent)
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            found = decide(texts_for(saved(ends, "ends")), pairs, members, percent, k)
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)
    level = groups if starred is None else left_join_sized(groups, starred.select("node", "star"), ["node"], salts=1)
    level = level.withColumn("star", F.coalesce("star", "node") if starred is not None else F.col("node"))
    if labels is not None:
        level = left_join_sized(level, labels.select(F.col("node").alias("star"), "label"), ["star"])
    level = saved(level.select("set_key", "first_id", "copies", (F.coalesce("label", "star") if labels is not None else F.col("star")).alias("label")), "level")
    found = saved(level.groupBy("label").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("rows")).filter("rows > 1").drop("rows"), "found")
    named = saved(left_join_sized(level.select("set_key", "label"), found.withColumn("named", F.lit(True)), ["label"]).filter("named").drop("named"), "named")
    out = left_join_sized(sets.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "set_key"), named, ["set_key"])
    return out.select("doc_id", "row_key", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of one row of each group: one with the smallest id; rows without words all stay; null ids come last; wholly repeated rows of a group count once."""
    groups = similar_groups(docs, id_col, text_col, **options).filter("label is not null").select("doc_id", "row_key", "label")
    chosen = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("c")).select("label", F.col("c.row_key").alias("best"))
    key = free_name(docs, "_row_key")
    told = left_join_sized(groups, saved(chosen, "chosen"), ["label"]).groupBy(F.col("row_key").alias(key)).agg(F.max(F.col("row_key") == F.col("best")).alias("stays"), F.count("*").alias("n"))
    told = saved(told.filter("not stays or n > 1").select(key, F.col("stays").alias(f"{key}_stays")), "told")
    rows = left_join_sized(docs.withColumn(key, _row_key(id_col, text_col)), told, [key])
    kept = rows.filter(F.col(f"{key}_stays").isNull()).select(*docs.columns)
    if told.filter(f"{key}_stays").isEmpty():
        return kept
    repeated = rows.filter(f"{key}_stays").dropDuplicates([key]).select(*docs.columns)
    return kept.unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")
