"""Sharding by proportional stratified interleaving: every shard has as many rows as any other, and of every source its share.

The rows of each source are shuffled by a seeded hash and ranked.  Row ``r`` of ``n`` stands at the fraction ``(r + 1/2) / n`` of the whole order, so
each stretch of that order holds of each source what the source's share is; equal stretches are the shards.

No order is put into one task: ranks within a source are sums over ranges of the hash and ranks within a range, places in the whole order are sums over
stretches of the fraction and ranks within a stretch.  As fractions are even for each source, no stretch is crowded, whatever a source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, left_join_sized, partitions, saved, sized, table

#: Bytes that a row has besides its text.
FRAME = 16
#: Ranges of the hash within a source.
RANGES = 4096
#: Rows of a stretch of the fraction, and the most stretches.
STRETCH, STRETCHES = 500, 1 << 16
#: Equal rows that one row stands for while they are spread.
COPIES = 10_000
#: Neighbouring rows that are written together.
ROWS_OF_A_FILE = 20_000


def _names(seed: int) -> dict[str, Column]:
    """Two hashes that name a row by id, source and text; the first is its place in the shuffle."""
    text, source = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), F.col("source").cast("string")
    h = F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id").isNull(), F.col("doc_id").cast("long"), source.isNull(), source, text)
    return {"h": h, "h2": F.xxhash64(F.lit(seed).cast("long"), text, source, F.col("doc_id").cast("long"))}


def _skinny(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, text_crc32, h, h2``: what the plan needs of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": (F.octet_length(text) + FRAME).cast("long"), "text_crc32": F.crc32(text)}
    return docs.select(*[c.alias(n) for n, c in (own | _names(seed)).items()])


def _before(rows: DataFrame, count: Column, outer: list[str], inner: str) -> DataFrame:
    """``outer, inner, before, total``: of each range how many come before it within ``outer``, and how many there are of ``outer``."""
    sums = rows.groupBy(*outer, inner).agg(F.sum(count).alias("_n"))
    w = Window.partitionBy(*outer)  # a row for each range
    earlier = F.sum("_n").over(w.orderBy(inner).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*outer, inner, F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("_n").over(w).alias("total"))


def plan(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, text_crc32, h, h2, place, shard, slot``: a row for each document, ``place`` its number in the whole order.

    Counts of shards are at most one apart and slots count from 0 without gaps.  Null texts are empty, null sources one source, null ids an id of their own;
    repeated rows each have a slot; a table without rows gives none; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("there is at least one shard")
    names = ["doc_id", "source", "size", "text_crc32", "h", "h2"]
    rows = saved(_skinny(docs, seed), "rows")
    # equal rows are one row with a count until they have their ranks
    groups = rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("range", F.pmod(F.shiftrightunsigned("h", 52), F.lit(RANGES)).cast("int"))
    groups = groups.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    groups = saved(groups, "groups")
    within = Window.partitionBy("key", "range").orderBy("h", "h2", "doc_id", "text_crc32", "size")
    earlier = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = saved(_before(groups, F.col("n"), ["key"], "range"), "ranges")
    ranked = left_join_sized(groups.withColumn("_in", earlier), ranges, ["key", "range"]).withColumn("first", F.col("before") + F.col("_in"))
    parts = ranked.select(*names, "key", "first", "n", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("_part"))
    spread = F.explode(F.sequence(F.col("_part") * COPIES, F.least(F.col("n"), (F.col("_part") + 1) * COPIES) - 1)).alias("_i")
    more = parts.filter("n > 1").repartition("h", "_part").select(*names, "key", "first", "total", spread).withColumn("rank", F.col("first") + F.col("_i")).drop("first", "_i")
    each = saved(parts.filter("n = 1").select(*names, "key", "total", F.col("first").alias("rank")).unionByName(more), "ranked")
    count = each.count()
    stretches = min(max(1, count // STRETCH), STRETCHES)
    # a fraction's stretch in whole numbers: no rounding puts a row into a stretch of others
    placed = each.withColumn("_f", (2 * F.col("rank") + 1) / (2 * F.col("total"))).withColumn("stretch", F.expr(f"cast((2 * rank + 1) * cast({stretches} as decimal(20, 0)) div (2 * total) as long)"))
    order = Window.partitionBy("stretch").orderBy("_f", "key", "rank")
    sums = saved(_before(placed, F.lit(1), [], "stretch").drop("total"), "stretches")
    numbered = left_join_sized(placed.withColumn("_in", F.row_number().over(order) - 1), sums, ["stretch"]).withColumn("place", (F.col("before") + F.col("_in")).cast("long"))
    shard = F.expr(f"cast(cast(place as decimal(20, 0)) * {shards} div {max(1, count)} as int)")
    begin = F.expr(f"cast((cast(shard as decimal(20, 0)) * {max(1, count)} + {shards - 1}) div {shards} as long)")
    return numbered.withColumn("shard", shard).select(*names, "place", "shard", (F.col("place") - begin).alias("slot"))


def mixture(planned: DataFrame) -> DataFrame:
    """``shard, source, n``: what each shard holds of each source."""
    return planned.groupBy("shard", "source").agg(F.count("*").alias("n"))


def write_shards(docs: DataFrame, folder: str, shards: int = 40, seed: int = 0) -> DataFrame:
    """Write all columns of ``docs`` and the slot as Parquet, a folder for each shard, files in the order of slots, and return the plan.

    Rows that are there once meet their slot by their name; of equal rows (in id, source and text) one stands for all, so their other columns are that one's.
    ``docs`` must not have columns ``shard``, ``slot`` or ``place`` of its own: they would be written twice.
    """
    if clash := {"shard", "slot", "place"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of these names are written: {sorted(clash)}")
    spark = docs.sparkSession
    planned = saved(plan(docs, shards, seed), "plan")
    names = {n: free_name(docs, "_" + n) for n in ("h", "h2")}
    keys = list(names.values())
    texts = docs.withColumns({names[n]: c for n, c in _names(seed).items()})
    spots = planned.select(*[F.col(n).alias(k) for n, k in names.items()], "place", "shard", "slot")
    often = saved(spots.groupBy(*keys).count().filter("count > 1").select(*keys), "often")
    single = texts.join(spots.join(sized(often), keys, "left_anti"), keys)
    copies = saved(texts.join(sized(often), keys, "left_semi").dropDuplicates(keys), "copies")
    several = left_join_sized(spots.join(sized(often), keys, "left_semi"), copies, keys)
    rows = single.unionByName(several).drop(*keys)
    block = F.floor(F.col("place") / F.lit(ROWS_OF_A_FILE))
    rows.repartition(partitions(spark), block).sortWithinPartitions("place").drop("place").write.partitionBy("shard").parquet(folder)
    return planned


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
