"""Benchmark decontamination with templates, in DataFrame functions only.

Numbers, units behind numbers, and names (capitalised words inside a sentence) become typed placeholders, so that a
question asked again with other values has the same template.  At every place of items and documents alike, the run of at
least ``WINDOW`` template words that goes on until it has ``LITERALS`` literal ones is hashed, so that a shared passage of that
many words, literal ones among them, is met at any alignment and whatever else the benchmark holds.  Equal hashes propose an
alignment of document and item, which is then read word by word, together with the pieces at the shifts near it: literal words
must agree, and slots must be filled consistently, one value of the item always standing for one value in the document.  Names of
several words, and numbers with their units, are one placeholder.  A copy without any such run left whole is not told.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, left_join_sized, saved, sized, table, tidy

WINDOW = 5
LITERALS = 3
#: words put in or left out move the rest of a copy: places up to ``DRIFT`` words off count where ``PIECE`` of them follow each other
DRIFT, PIECE = 4, 3
#: bytes of the benchmark's tables (compressed) up to which they are broadcast
BROADCAST = 16 << 20
#: fixed values: units that are recognised behind a number
UNITS = "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometers kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent degrees dollars euros cents usd eur gbp mph kph km/h m/s kb mb gb tb hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa".split()
_SPACE = r"[\x20\x09-\x0D]+"


def template(text: Column) -> Column:
    """Each word stays one word; only its value is replaced."""
    # what a match begins with is asked first, before what stands in front of it: most places fail at once
    t = F.regexp_replace(text, r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]+(?:[.,:/][0-9]+)*", "\u0001")
    units = "|".join(sorted((u.replace("/", "\\/") for u in UNITS), key=len, reverse=True))
    t = F.regexp_replace(t, rf"(\x01[\x20\x09-\x0D-])(?:square|cubic|sq|cu)(?=[\x20\x09-\x0D](?:{units})(?![\p{{L}}\p{{N}}]))", "$1\u0002")
    t = F.regexp_replace(t, rf"(?<=[\x01\x02\x20\x09-\x0D-])(?<=\x01|\x01[\x20\x09-\x0D-]|\x02[\x20\x09-\x0D])(?:{units}|%)(?![\p{{L}}\p{{N}}])", "\u0002")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[^.!?:\x20\x09-\x0D][\x20\x09-\x0D])\p{Lu}[\p{L}'’-]*", "\u0003")
    return F.lower(t)


def template_words(text: Column) -> Column:
    """The template's words; a run of name words is one, and so is a number with its unit."""
    t = F.regexp_replace(template(text), rf"\x03(?:{_SPACE}\x03)+", "\u0003")
    return words_of(F.regexp_replace(t, rf"\x01[\x20\x09-\x0D-]?\x02(?:{_SPACE}\x02)*", "\u0002"))


def values_of(text: Column) -> Column:
    """The text behind each word of ``template_words``."""
    t = F.regexp_replace(template(text), rf"\x03{_SPACE}(?=\x03)", "\u0003\u0004")
    sizes = F.transform(words_of(F.regexp_replace(t, rf"([\x01\x02]){_SPACE}(?=\x02)", "$1\u0004")), lambda w: F.size(F.split(w, "\u0004")))
    # for each raw word the number of its run, then the first word of each run
    runs = F.flatten(F.transform(sizes, lambda n, i: F.array_repeat(i, n)))

    def joined(words: Column, run: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(run)), lambda i: (i == 0) | (i == F.size(run)) | (F.get(run, i) != F.get(run, i - 1)))
        cut = F.transform(F.array(first), lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.array_join(F.slice(words, F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k)), " ")))
        return F.get(cut, 0)

    one = F.transform(F.array(F.struct(words_of(text).alias("words"), runs.alias("runs"))), lambda r: F.when(F.size(r["runs"]) > 0, joined(r["words"], r["runs"])).otherwise(F.array().cast("array<string>")))
    return F.get(one, 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def is_slot(word: Column) -> Column:
    return word.contains("\u0001") | word.contains("\u0002") | word.contains("\u0003")


def windows(words: Column) -> Column:
    """``at`` and hash of the shortest run from each place on with ``WINDOW`` words and ``LITERALS`` literal ones; none where the text ends before."""
    plain = F.transform(_upto(F.size(words) - WINDOW), lambda i: F.struct(i.alias("at"), F.when(literals(F.slice(words, i + 1, WINDOW)) >= LITERALS, F.xxhash64(F.slice(words, i + 1, WINDOW))).alias("hash")))
    return F.concat(F.filter(plain, lambda w: w["hash"].isNotNull()), long_windows(words))


def _upto(last: Column) -> Column:
    """0 to ``last``; nothing if that is below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def long_windows(words: Column) -> Column:
    """The runs of ``windows`` that have more than ``WINDOW`` words, as they begin among slots."""
    slots = F.filter(words, is_slot)
    literal = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~is_slot(F.get(words, i)))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")

    def stretches(at: Column) -> Column:
        """For each literal word the places behind the literal word before it whose runs are long: they end behind the same literal word."""
        all_of = F.transform(
            F.sequence(F.lit(0), F.size(at) - LITERALS),
            lambda k: F.struct(
                F.when(k > 0, F.get(at, k - 1) + 1).otherwise(F.lit(0)).alias("first"), F.least(F.get(at, k), F.get(at, k + LITERALS - 1) - WINDOW).alias("last"), (F.get(at, k + LITERALS - 1) + 1).alias("end")
            ),
        )
        return F.filter(all_of, lambda r: r["last"] >= r["first"])

    def runs(r: Column) -> Column:
        return F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, r["end"] - i)).alias("hash")))

    found = F.get(F.transform(F.array(literal), lambda at: F.when(F.size(at) >= LITERALS, F.flatten(F.transform(stretches(at), runs)))), 0)
    # a long run begins with WINDOW words of which too many are slots
    return F.when(F.size(slots) > WINDOW - LITERALS, F.coalesce(found, none)).otherwise(none)


def text_windows(split: DataFrame, sizes: list[int]) -> DataFrame:
    """``key, doc_at, hash`` of all runs that may meet an item's, from ``key, words`` (and ``raw`` with ``sizes``, the lengths of thin items).

    Runs of WINDOW words are hashed whatever their words, in generated code, as an item's run of equal hash has its literal words.
    """
    more = F.concat(long_windows(F.col("words")), whole_windows(F.col("words"), F.col("raw"), sizes)) if sizes else long_windows(F.col("words"))
    parts = split.select("key", "words", more.alias("more"))
    n = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    placed = parts.select("key", "words", "more", F.explode(_upto(n + F.size("more") - 1)).alias("i"))
    mine, other = F.col("i") < n, F.get("more", F.col("i") - n)
    plain = F.xxhash64(*[F.get("words", F.col("i") + k) for k in range(WINDOW)])
    return placed.select("key", F.when(mine, F.col("i")).otherwise(other["at"]).alias("doc_at"), F.when(mine, plain).otherwise(other["hash"]).alias("hash"))


def literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~is_slot(w)))


def whole_hash(words: Column, raw: Column) -> Column:
    """The template's hash; the values' where it has fewer than ``LITERALS`` literal words."""
    return F.when(literals(words) < LITERALS, F.xxhash64(raw)).otherwise(F.xxhash64(words))


def whole_windows(words: Column, raw: Column, sizes: list[int]) -> Column:
    """``at`` and hash of the runs of ``sizes`` words that are too short for ``windows`` or have too few literal words."""
    parts = []
    for n in sizes:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        few = places if n < WINDOW else F.filter(places, lambda i: literals(F.slice(words, i + 1, n)) < LITERALS)
        parts.append(F.transform(few, lambda i: F.struct(i.alias("at"), whole_hash(F.slice(words, i + 1, n), F.slice(raw, i + 1, n)).alias("hash"))))
    return F.concat(*parts)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, raw, words, plain``: a table of the items' template words, the text behind each, and all words in lower case; null and empty items are left out."""
    text = F.col("text").cast("string")
    plain = F.transform(words_of(text), lambda w: F.lower(w))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), values_of(text).alias("raw"), template_words(text).alias("words"), plain.alias("plain"))
    return saved(items.filter(F.size("words") > 0).distinct(), "items")


def short_leaks(base: DataFrame, items: DataFrame) -> DataFrame:
    """Texts with an item of fewer than ``WINDOW`` words: too little for a template, so its words must follow each other, values and all."""
    short = saved(items.filter(F.size("plain") < WINDOW).select("item_id", F.size("plain").alias("n"), F.array_join("plain", " ").alias("said")), "short-items")
    sizes = sorted(r[0] for r in short.select("n").distinct().collect())  # of 1 to WINDOW - 1
    split = base.select("key", F.transform(words_of(F.col("text")), lambda w: F.lower(w)).alias("plain"))

    def runs(n: int) -> Column:
        places = F.when(F.size("plain") >= n, F.sequence(F.lit(0), F.size("plain") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice("plain", i + 1, n), " "))

    found = split.select("key", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))).alias("said")).join(sized(short, BROADCAST, 4 * BROADCAST), "said").distinct()
    n = F.col("n").cast("long")
    return found.select("key", "item_id", n.alias("matched"), F.lit(0).cast("long").alias("slots"), n.alias("item_words"))


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of all items; ``thin`` ones are met as a whole, as templates of few literal words would match anything."""
    whole = F.array(F.struct(F.lit(0).alias("at"), whole_hash(F.col("words"), F.col("raw")).alias("hash")))
    own = F.when(F.col("thin"), whole).otherwise(windows(F.col("words")))
    return items.select("item_id", F.explode(own).alias("w")).select("item_id", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"))


@tidy
def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, enough: int = 13, text_col: str = "text") -> DataFrame:
    """``key, item_id, matched, slots, item_words``: one row for each different text (``key``: its md5) and item it holds.

    A text holds an item if, at one alignment and the shifts near it, ``share`` of the item's template words or ``enough`` of them
    match (and at least WINDOW, or all).  Items of fewer than WINDOW words must be there word for word, whatever their case (no slots); items of fewer than LITERALS
    literal words are told by their own values only; null texts hold nothing; repeated rows share their row here.
    """
    spark = docs.sparkSession
    items = benchmark_items(benchmark)
    text = F.col(text_col).cast("string")
    base = docs.filter(F.col(text_col).isNotNull()).select(F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    told = items.filter(F.size("plain") >= WINDOW).withColumn("thin", (literals(F.col("words")) < LITERALS) | (F.size("words") < WINDOW))
    sizes = sorted(r[0] for r in told.filter("thin").select(F.size("words")).distinct().collect())
    # columns of their own: the windows read them many times
    split = base.select("key", template_words(F.col("text")).alias("words"), *([values_of(F.col("text")).alias("raw")] if sizes else []))
    hashed = text_windows(split, sizes)
    probes = saved(item_windows(told), "item-windows")
    found = hashed.join(sized(probes, BROADCAST, 4 * BROADCAST), "hash")
    aligned = saved(found.select("key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct(), "alignments")
    keys = saved(aligned.select("key").distinct().withColumn("hit", F.lit(True)), "keys")
    texts = left_join_sized(base, keys, ["key"]).filter("hit").groupBy("key").agg(F.first("text").alias("text"))
    # the words of each text are found once; an alignment takes along only those that it reads
    texts = saved(texts.select("key", values_of(F.col("text")).alias("doc_raw"), template_words(F.col("text")).alias("doc_words")), "texts")
    both = aligned.join(sized(told.select("item_id", "words", "raw"), BROADCAST, 4 * BROADCAST), "item_id").join(sized(texts), "key")
    first = F.greatest(F.col("shift") - DRIFT, F.lit(0))
    read = F.greatest(F.col("shift") + F.size("words") + DRIFT - first, F.lit(0))
    both = both.select("key", "item_id", (F.col("shift") - first).alias("shift"), "words", "raw", *[F.slice(c, first + 1, read).alias(c) for c in ("doc_words", "doc_raw")])
    # the same text matches whatever its template: a capital is a name inside a sentence and a plain word at its start
    lower = lambda c: F.transform(F.col(c), lambda w: F.lower(w))
    both = both.withColumns({"plain": lower("raw"), "doc_plain": lower("doc_raw")})
    places = F.sequence(F.lit(0), F.size("words") - 1)
    offs = sorted(range(-DRIFT, DRIFT + 1), key=abs)
    for n, d in enumerate(offs):
        both = both.withColumn(f"same{n}", F.transform(places, lambda i: F.coalesce(F.get("words", i) == F.get("doc_words", i + F.col("shift") + d), F.lit(False)) | F.coalesce(F.get("plain", i) == F.get("doc_plain", i + F.col("shift") + d), F.lit(False))))

    def piece(n: int, i: Column) -> Column:
        """Place ``i`` and its neighbours are the same for PIECE places."""
        at = [F.coalesce(F.get(f"same{n}", i + k), F.lit(False)) for k in range(1 - PIECE, PIECE)]
        runs = [functools.reduce(Column.__and__, at[k : k + PIECE]) for k in range(PIECE)]
        return functools.reduce(Column.__or__, runs)

    straight = F.transform(places, lambda i: F.when(F.get("same0", i), F.lit(0)))
    near = F.transform(places, lambda i: F.coalesce(F.when(F.get("same0", i), F.lit(0)), *[F.when(piece(n, i), F.lit(d)) for n, d in enumerate(offs) if n]))
    both = both.withColumn("near", near)

    def taken(i: Column) -> Column:
        """Place ``i`` would cross or share the document's word of a place that is nearer to the shift."""
        mine = F.get("near", i)

        def crosses(k: Column) -> Column:
            other = F.get("near", i + k)
            first = (F.abs(other) < F.abs(mine)) | ((F.abs(other) == F.abs(mine)) & (k < 0))
            return F.coalesce(first & F.when(k < 0, k + other >= mine).otherwise(k + other <= mine), F.lit(False))

        return F.exists(F.array(*[F.lit(k) for k in range(-2 * DRIFT, 2 * DRIFT + 1) if k]), crosses)

    ordered = F.transform(places, lambda i: F.when(~taken(i), F.get("near", i)))
    # the one shift alone is a reading too: pieces near it may fill slots otherwise
    both = both.select("key", "item_id", "shift", "words", "raw", "doc_raw", F.explode(F.array(straight, ordered)).alias("off"))
    pairs = F.transform(
        places,
        lambda i: F.struct(
            is_slot(F.get("words", i)).alias("slot"),
            F.get("off", i).isNotNull().alias("same"),
            F.get("raw", i).alias("mine"),
            F.get("doc_raw", i + F.col("shift") + F.get("off", i)).alias("theirs"),
        ),
    )
    both = both.select("key", "item_id", pairs.alias("pairs")).select("key", "item_id", "pairs", F.filter("pairs", lambda p: p["slot"] & p["same"]).alias("filled"))
    # a value of the item that stands for different values in the document fills its slots for no question
    fits = F.filter("filled", lambda p: F.size(F.array_distinct(F.transform(F.filter(F.col("filled"), lambda q: q["mine"] == p["mine"]), lambda q: q["theirs"]))) == 1)
    literal = F.size(F.filter("pairs", lambda p: ~p["slot"] & F.coalesce(p["same"], F.lit(False))))
    counted = both.select("key", "item_id", F.size(fits).cast("long").alias("slots"), literal.cast("long").alias("literal"), F.size("pairs").cast("long").alias("item_words"))
    counted = counted.withColumn("matched", F.col("literal") + F.col("slots"))
    good = counted.filter((F.col("matched") >= F.least(F.lit(WINDOW), F.col("item_words"))) & ((F.col("matched") >= F.lit(share) * F.col("item_words")) | (F.col("matched") >= enough)))
    best = good.groupBy("key", "item_id").agg(F.max(F.struct("matched", "slots", "item_words")).alias("b"))
    best = best.select("key", "item_id", F.col("b.matched").alias("matched"), F.col("b.slots").alias("slots"), F.col("b.item_words").alias("item_words"))
    # texts are searched for short items only if the benchmark has any
    return best if items.filter(F.size("plain") < WINDOW).isEmpty() else best.unionByName(short_leaks(base, items))


def leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, matched, slots, item_words`` of every row of ``docs`` that holds an item; an empty table gives no rows."""
    leaks = find_leaks(docs, benchmark, **options)
    per_text = saved(leaks.groupBy("key").agg(F.collect_list(F.struct("item_id", "matched", "slots", "item_words")).alias("found")), "leaks-by-text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string").cast("binary")).alias("key"))
    hits = left_join_sized(rows, per_text, ["key"]).filter(F.col("found").isNotNull())
    return hits.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.matched", "f.slots", "f.item_words")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows without a text stay."""
    key, hit = free_name(docs, "_key"), free_name(docs, "_hit")
    leaks = saved(find_leaks(docs, benchmark, **options).select(F.col("key").alias(key)).distinct().withColumn(hit, F.lit(True)), "leaks")
    rows = docs.withColumn(key, F.md5(F.col("text").cast("string").cast("binary")))
    return left_join_sized(rows, leaks, [key]).filter(F.col(hit).isNull()).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
