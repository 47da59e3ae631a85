"""Spelling variants, shards and cross-tokenizer alignment against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, cross_tokenizer, shards, spelling

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- spelling ------------------------------------------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, every=97):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    by_len = collections.defaultdict(list)
    for w in words:
        by_len[len(w)].append(w)
    out, form = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_len[len(w) + k] if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = len(others)
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, n, out[w], form[w], words.get(form[w]), root(w)) for w, n in words.items())


def got_variants(df, **options):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(df, **options).collect())


def test_variants_against_brute_force(spark):
    g = random.Random(4)
    letters = "abcdeéßÀ×"
    base = ["".join(g.choice(letters) for _ in range(g.randrange(5, 9))) for _ in range(60)]
    def mutate(w):
        i = g.randrange(len(w))
        return g.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + g.choice(letters) + w[i:], w[:i] + g.choice(letters) + w[i + 1 :]])
    rows = [(i, " ".join(mutate(g.choice(base)).upper() if g.random() < 0.1 else mutate(g.choice(base[: 1 + i % 60])) for _ in range(80)) + " ١٢ 漢字abcde") for i in range(60)]
    rows += [(None, "gamma gamma gammas"), (None, None), (7, ""), (8, "gamma"), (8, "gamma gammas gammas"), (9, "x" * 30_000 + " " + "y" * 3000), (9, "y" * 3000 + "é " + "y" * 3000), (10, "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3001), (11, "y" * 3001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    want = plain_variants(rows)
    assert len(want) > 80 and any(r[3] for r in want)
    assert got_variants(df) == want
    assert got_variants(df, every=3) == plain_variants(rows, 3)


def test_split_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    g = random.Random(5)
    rows = [(i, " ".join("".join(g.choice("ab") for _ in range(g.randrange(5, 8))) for _ in range(200))) for i in range(10)]
    assert got_variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (None, "a b c 1234")]):
        assert got_variants(spark.createDataFrame(rows, "doc_id long, text string")) == []


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["wordaaaa"] * 3 + ["wordaaab"] * 6 + ["wordaabb"] * 12 + ["wordabbb"] * 24 + ["wordbbbb"] * 48))]
    got = {r[0]: r[5] for r in got_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=10**9)}
    assert set(got.values()) == {"wordbbbb"} and len(got) == 5


# -- shards --------------------------------------------------------------------------------------------------------

def check_plan(rows, planned, n):
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in planned) == sorted(repr((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for d, t, _ in rows)
    slots = collections.defaultdict(list)
    for r in planned:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    sizes = [len(slots[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1
    total = collections.Counter(s for _, _, s in rows)
    held = collections.Counter((r.shard, r.source) for r in planned)
    for s, m in total.items():  # each stretch has of each source what its share is
        for k in range(n):
            assert abs(held[k, s] - m / n) < 2 + len(total) * m / len(rows)


def test_shards_match_the_mixture(spark):
    g = random.Random(6)
    rows = [(i, g.choice(["", "a", "é" * 9, None, "word " * g.randrange(50)]), g.choice(["big"] * 6 + ["s1", "s2", None, "s3"])) for i in range(1500)]
    rows += [(5, "same", "big")] * 700 + [(None, None, None)] * 40 + [(None, "x", "s1"), (None, "x", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("n", F.lit(3))
    first = shards.plan(df, 7).collect()
    check_plan(rows, first, 7)
    again = shards.plan(df.repartition(9), 7).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))  # whatever the partitions
    other = shards.plan(df, 7, seed=1).collect()
    assert sorted(map(repr, first)) != sorted(map(repr, other))


def test_few_rows_and_copies_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 10)
    monkeypatch.setattr(shards, "STRETCH", 16)
    for rows in ([], [(1, "a", "x")], [(i, "t", "x") for i in range(3)] + [(9, "u", "y")] * 95):
        check_plan(rows, shards.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5).collect(), 5) if rows else None
    assert shards.plan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_written_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_OF_A_FILE", 30)
    rows = [(i, f"text {i % 50}", f"s{i % 3}", i) for i in range(300)] + [(7, "same", "s0", 7)] * 60 + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    planned = shards.write_shards(df, f"file://{tmp_path}/out", 4)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(repr((r.doc_id, r.text, r.source, r.extra)) for r in got) == sorted(map(repr, rows))
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in got) == sorted((r.shard, r.slot, str(r.doc_id)) for r in planned.collect())
    with pytest.raises(ValueError):
        shards.write_shards(df.withColumn("Slot", F.lit(1)), f"file://{tmp_path}/no")


# -- alignment -----------------------------------------------------------------------------------------------------

def test_gallop():
    g = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 2000), (700, 900), (2000, 3), (300, 100_000)):
        short, long = np.sort(g.integers(0, 5000, n)), np.sort(g.choice(200_000, m, replace=False))
        assert (cross_tokenizer.gallop(short, long) == np.searchsorted(long, short)).all()


def plain_alignment(texts):
    al = cross_tokenizer.Aligner.of(A, B)
    out, pairs = [], []
    for text in texts:
        if not text:
            out.append((0, 0, 0, 0, ""))
            pairs.append([])
            continue
        a = al.a.encode(" " + text, add_special_tokens=False).ids
        b = al.b.encode(text)
        data = (" " + text).encode()
        if b"".join(al.a_bytes[i] for i in a) != data or b"".join(al.b_bytes[i] for i in b) != data:
            out.append((0, 0, 0, 0, ""))
            pairs.append([])
            continue
        place = lambda ids, table: [(sum(len(table[j]) for j in ids[:i]), sum(len(table[j]) for j in ids[: i + 1]), t) for i, t in enumerate(ids)]
        x, y = place(a, al.a_bytes), place(b, al.b_bytes)
        links = [(s[2], t[2]) for s in x for t in y if s[0] < t[1] and t[0] < s[1]]
        ends = sorted({s[1] for s in x} & {t[1] for t in y})
        groups, last = [], 0
        for e in ends:
            groups.append(",".join(str(s[2]) for s in x if last < s[1] <= e) + "|" + ",".join(str(t[2]) for t in y if last < t[1] <= e))
            last = e
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.append(links)
    counts = collections.Counter(p for ps in pairs for p in ps)
    top = collections.defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(*o[:4], sum(counts[p] == top[p[1]] for p in ps), sum(counts[p] for p in ps), o[4]) for o, ps in zip(out, pairs)]


TEXTS = ["the cat sat on the mat", " leading  and   many spaces ", "Größe naïve café ▁ block", "a▁b", "<|endoftext|> and <s> and <0x41> </s>", "tabs\tand\nlines\n\n  indented\r\n x", "漢字 and ١٢٣ and 👩‍👩‍👧 emoji", None, "", " ", "\0 nul", "it's we'll don't 'tis", "x" * 300, "internationalisation of words " * 20, "ﬁ ligature é accent", "the  cat", " nbsp  wide", "1234567 12.5% $99,000"]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_alignment_against_brute_force(spark, most):
    g = random.Random(2)
    words = ["the", "of", "token", "align", "Größe", "é", "zzyzx", "42", "-", "\n", "don't", "", "…"]
    texts = TEXTS + [" ".join(g.choice(words) for _ in range(g.randrange(1, 40))) for _ in range(60)] + ["the cat sat on the mat"] * 3
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, TEXTS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("n_a", F.lit("x"))
    want = sorted(map(repr, ((d, *x) for (d, _), x in zip(rows, plain_alignment([t for _, t in rows])))))
    assert sorted(repr(tuple(r)) for r in cross_tokenizer.compare(df, A, B, most).collect()) == want


def test_no_documents_to_align(spark):
    assert cross_tokenizer.compare(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_parts_are_encoded_as_the_whole():
    al, g = cross_tokenizer.Aligner.of(A, B), random.Random(3)
    signs = ["a", "Zq", " ", " ", "  ", "\n", "\t", "é", "漢", "▁", "'s", " ", "́", "12", "!", "<s>", "👍", "İ"]
    texts = ["".join(g.choice(signs) for _ in range(g.randrange(1, 30))) for _ in range(4000)]
    for t, (a, b) in zip(texts, al.encode(texts)):
        assert a.tolist() == al.a.encode(" " + t, add_special_tokens=False).ids and b.tolist() == al.b.encode(t), repr(t)


# -- joins that are sized ------------------------------------------------------------------------------------------

def joins(df):
    df.collect()
    return set(re.findall(r"(\w+Join)\b", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("salts", [1, 16])
def test_a_table_beyond_the_limit_is_not_broadcast_by_spark(spark, salts):
    table = common.saved(spark.range(2000).select("id", (F.col("id") * 2).alias("double")), "table")
    left = spark.range(3000).withColumn("x", F.col("id") % 7)
    joined = common.left_join_sized(left, table, ["id"], most=1, salts=salts)
    assert joins(joined) == {"SortMergeJoin"}
    assert sorted(map(tuple, joined.select("id", "x", "double").collect())) == [(i, i % 7, 2 * i if i < 2000 else None) for i in range(3000)]
    assert joins(left.join(common.sized(table, most=1), "id")) == {"SortMergeJoin"}
    assert joins(common.left_join_sized(left, table, ["id"])) == joins(left.join(common.sized(table), "id")) == {"BroadcastHashJoin"}


def test_a_table_is_sized_by_what_it_takes_in_memory(spark):
    many = common.saved(spark.range(400_000).select("id", F.lit("a word of some length").alias("w")), "many")
    assert common.written_bytes(many) < common.SMALL and common.memory_bytes(many) > 400_000 * 80
    assert not common.is_small(many) and common.is_small(many.limit(1000))
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "äb", [1, 2], ["x", None], (3, "yy"))], "a long, s string, n array<long>, t array<string>, r struct<a: int, b: string>")
    assert common.memory_bytes(odd) == 2 * (64 + 16 * 5) + 3 + 16 + 17 + 2 * 24 + 2
    assert common.memory_bytes(odd.filter("a > 2")) == 0
