import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import common, components, decontaminate, jaccard_join, suffix_dedup
from logloom.llm.shingles import shingle_sets

WORDS = "[^\x20\x09-\x0d]+"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k=5):
    w = re.findall(WORDS, (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, n=140):
    """Groups of near copies around the threshold, a shared passage, and noise."""
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randrange(1, 5)))
    passage = [word() for _ in range(25)]
    bases = [[word() for _ in range(g.choice([6, 30, 60, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(g.choice(bases))
        for _ in range(g.choice([0, 0, 1, 1, 2, 3, 4])):
            w[g.randrange(len(w))] = word()
        if g.random() < 0.2:
            w = [word() for _ in range(30)] + passage
        rows.append((i * 3, (" " if g.random() < 0.5 else "\n").join(x.upper() if g.random() < 0.1 else x for x in w)))
    return rows + [(1, None), (2, ""), (4, " \n"), (5, "one two"), (8, "ONE two"), (7, rows[0][1]), (7, rows[0][1]), (None, rows[0][1]), (None, "lonely text without id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, label string")
    got = jaccard_join.similar_groups(df)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(rows)
    kept = jaccard_join.one_of_each(df).collect()
    want = {c for d, n, c in brute(rows) if n and c is not None}
    assert kept[0].asDict().keys() == {"doc_id", "text", "label"}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want | {1, 2, 4})
    assert [r.text for r in kept if r.doc_id is None] == ["lonely text without id"]


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"A b  c d e f", b"", b"x y", b"a\tb c d e f"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 0, 1, 2] and (sets[0] == sets[3]).all()
    assert (shingle_sets([texts[0]])[0] == sets[0]).all()


def test_join_of_nothing(spark):
    assert jaccard_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[-1] for r in jaccard_join.similar_groups(blank).collect()) == [1, 2]


# -- repeated strings ----------------------------------------------------------------------------------------------

def stripped(rows, length):
    where = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(data):
        for s in range(len(t) - length + 1):
            where[t[s : s + length]].append((i, s))
    cover = [bytearray(len(t)) for t in data]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + length] = b"\1" * length
    return sorted((str(d), len(t), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(bytes(x for x, m in zip(t, c) if not m)).hexdigest()) for (d, _), t, c in zip(rows, data, cover))


@pytest.mark.parametrize("large", [2000, 1])
def test_repeats_equal_brute_force(spark, large):
    g = random.Random(3)
    bases = ["".join(g.choice("abcdé ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(60):
        b = list(g.choice(bases))
        for _ in range(g.randrange(0, 6)):
            b[g.randrange(300)] = g.choice("xyz")
        rows.append((i, "".join(g.choice("abcdefgh") for _ in range(g.randrange(0, 50))) + "".join(b)[g.randrange(0, 100) :] + "q" * g.randrange(0, 120)))
    rows += [(100, "ab" * 100), (101, "a" * 150), (102, None), (103, ""), (104, "zz"), (105, rows[3][1]), (105, rows[3][1]), (None, "é" * 90 + "b\0c")]
    df = spark.createDataFrame([(d, t, b"k") for d, t in rows], "doc_id long, text string, key binary")
    got = suffix_dedup.strip_repeats(df, length=40, gram=16, large=large).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == stripped(rows, 40)


def test_matching_statistics():
    g = random.Random(0)
    blocks = [bytes(g.choice(b"ab") for _ in range(g.randrange(1, 60))) for _ in range(12)]
    index = suffix_dedup.RunIndex(blocks)
    got = index.matching_statistics()
    whole = [(b, i) for b in blocks for i in range(len(b))]
    for n, (b, i) in enumerate(whole):
        best = 0
        for m, (c, j) in enumerate(whole):
            if m != n:
                k = 0
                while i + k < len(b) and j + k < len(c) and b[i + k] == c[j + k]:
                    k += 1
                best = max(best, k)
        assert got[n] == best
    assert len(index.run_start) < len(index.bytes)


def test_nothing_to_strip(spark):
    assert suffix_dedup.strip_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- benchmark items -----------------------------------------------------------------------------------------------

ITEM = "Tom has 5 apples and gives 3 apples to Anna who walks 12 km before Tom eats 5 apples at home today"


def test_templates(spark):
    docs = [
        (10, "Well then Bob has 7 apples and gives 2 apples to Mary who walks 30 miles before Bob eats 7 apples at home today yes"),  # other values
        (11, "filler words " * 40 + ITEM + " more words" * 30),  # word for word
        (12, None), (13, ""), (14, "apples and pears and 5 km of road"),
        (15, "Well then Bob has 7 apples and gives 2 pears for Mary who runs 30 miles"),
        (11, "filler words " * 40 + ITEM + " more words" * 30),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, found string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.leaked(df, items).collect())
    assert found == [(10, 1), (11, 1), (11, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [12, 13, 14, 15]
    assert decontaminate.leaked(df.limit(0), items).count() == 0 and decontaminate.leaked(df, items.limit(0)).count() == 0


def test_inconsistent_slots(spark):
    item = "red 5 red 5 red 5 red 5 blue 7 blue 7"
    docs = spark.createDataFrame([(1, "red 8 red 8 red 8 red 8 blue 9 blue 9"), (2, "red 1 red 2 red 3 red 4 blue 9 blue 6")], "doc_id long, text string")
    got = {r.doc_id: r.slots for r in decontaminate.leaked(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1] == 6 and got.get(2, 0) == 0


def leaks(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontaminate.leaked(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())


def test_items_of_many_slots_at_all_offsets(spark):
    heavy, thin = "Tom has 3 apples Ann has 5 pears Bob has 7 plums", "sum 3 5 7 11 13 17"
    other = "the quick brown fox jumps over the lazy dog"
    docs = [" ".join(["well"] * i + [text] + ["then"] * 9) for text in (heavy, thin) for i in range(10)] + ["sum 4 5 7 11 13 17 then"]
    want = [(i, i // 10) for i in range(20)]
    assert leaks(spark, docs, [heavy, thin, other]) == want
    assert leaks(spark, docs, [heavy, thin, other, "what is five plus six"]) == want


def test_values_of_other_lengths_and_words_put_in(spark):
    items = ["Tom has 3 apples Ann has 5 pears Bob has 7 plums", "in all the farm of Tom has 5 km of fence and 3 kg of seed", "who is the Mary Jane Watson"]
    docs = [
        "Tom has 4 apples Mary Lee has 6 pears Jo Ann Poe has 8 plums",
        "in all the farm of Mary Lee has 6 square km of fence and 4 cubic inches of seed",
        "tell me who is the John Smith then",
        "Tom has 3 apples Ann now has 5 pears",
        "nothing of this is there at all and so it stays",
    ]
    assert leaks(spark, docs, items) == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_planted_questions_asked_again(spark):
    """Items asked with other names, numbers and units, anywhere in a document, in other words around; clean documents hold nothing."""
    g = random.Random(21)
    word = lambda: "".join(g.choice("abcdefghijklm") for _ in range(g.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    name = lambda: word().capitalize() + g.choice(["", "", f" {word().capitalize()}"])
    number = lambda: g.choice([str(g.randrange(2, 99)), f"{g.randrange(2, 9)}.{g.randrange(9)}", f"{g.randrange(2, 99)} {g.choice(['km', 'kg', 'hours', 'percent'])}"])
    shapes = [[g.choice([word(), word(), word(), "NAME", "NUMBER"]) for _ in range(g.randrange(14, 30))] for _ in range(25)]
    fill = lambda shape: " ".join(name() if w == "NAME" else number() if w == "NUMBER" else w for w in shape)
    items = [(i, fill(s)) for i, s in enumerate(shapes)]
    docs = [(i, f"{prose(g.randrange(5, 40))} {fill(s)} {prose(g.randrange(5, 40))}") for i, s in enumerate(shapes)]
    docs += [(100 + i, f"{t} {prose(20)}") for i, t in items] + [(200 + i, f"{prose(40)} {name()} {prose(9)} {number()} {prose(9)}") for i in range(40)]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in found for i in range(25)) >= 0.9 * 25 and all((100 + i, i) in found for i in range(25))
    assert not [k for k in found if k[0] >= 200] and any(r.slots for k, r in found.items() if k[0] < 25)
    assert all(found[100 + i, i].matched == found[100 + i, i].item_words for i in range(25))


def test_capital_inside_a_sentence(spark):
    """A verbatim copy in mid-sentence matches in every word: its first word is a name there and a plain word in the item."""
    item = "Every morning the old keeper climbs the narrow stair to light the lamp"
    docs = spark.createDataFrame([(1, f"he wrote that {item} and left")], "doc_id long, text string")
    row = decontaminate.leaked(docs, spark.createDataFrame([(5, item), (6, None), (7, "")], "item_id long, text string")).first()
    assert (row.item_id, row.matched, row.item_words) == (5, 13, 13)


def test_decontamination_is_native(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = decontaminate.leaked(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_star_stands_around_the_middle_of_its_copies(spark):
    """Copies that all link with one text, but not with each other, join its star, so that no pairs of theirs are left over."""
    g = random.Random(5)
    base = [f"w{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for i in range(1, 61):
        w = list(base)
        w[g.randrange(5, 48)] = w[g.randrange(55, 98)] = f"x{i}"  # 10 of 100 shingles: 90 of 110 in common with the text, and 80 to 90 of 120 with a copy
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join.summarise(docs, "doc_id", "text", 5, 80)
    nodes = sets.withColumnRenamed("row", "node")
    texts = lambda wanted: jaccard_join.texts_of(docs, "doc_id", "text", nodes, wanted)
    starred, _, labels = jaccard_join.make_stars(nodes, texts, 80, 5, 3)
    assert starred.count() >= 55
    left = jaccard_join.candidates(nodes.select("node", "n", "prefix"), starred, labels, 80)
    assert left.count() <= 20


def test_pairs_with_stars_come_before_pairs_of_single_sets(spark):
    """Once the pairs with a star are decided, single sets that joined its component are not paired with each other."""
    shared = b"".join((i << 30).to_bytes(8, "little") for i in range(1, 22))
    prefixes = spark.createDataFrame([(i, 100, bytearray(shared)) for i in range(10)], "node long, n long, prefix binary")
    starred = spark.createDataFrame([(1, 0, 100, 2, bytearray(b""))], "node long, star long, n long, d long, diff binary")
    labels = lambda nodes: spark.createDataFrame([(i, 0) for i in nodes], "node long, label long")
    first = jaccard_join.candidates(prefixes, starred, labels([0]), 80, "stars").collect()
    assert sorted((r.a, r.b) for r in first) == [(0, i) for i in range(2, 10)]
    left = jaccard_join.candidates(prefixes, starred, labels([0, *range(2, 8)]), 80, "singles").collect()
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in left) == [(i, j) for i in range(2, 9) for j in (8, 9) if i < j]


# -- large tables --------------------------------------------------------------------------------------------------

def test_tables_beyond_the_limit_are_never_broadcast(spark, monkeypatch):
    """The Jaccard join with every table taken for a large one: no plan leaves a broadcast to Spark's own guess, and the groups are those of brute force."""
    rows, plans = near_copies(5), []

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.saved(df, *args, **options)

    monkeypatch.setattr(common, "written_bytes", lambda df: 1 << 40)
    monkeypatch.setattr(jaccard_join, "saved", seen)
    monkeypatch.setattr(components, "saved", seen)
    groups = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, groups), key=repr) == brute(rows)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_rows_that_go_are_not_broadcast_beyond_the_limit(spark, monkeypatch):
    """What the pipeline's second stage joins with all documents: the table of rows that go is large, and Spark is not left to guess its size."""
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(100)], "doc_id long, text string")
    groups = common.saved(docs.select("doc_id", jaccard_join._row_key("doc_id", "text").alias("row_key"), F.floor(F.col("doc_id") / 2).alias("label")), "groups")
    monkeypatch.setattr(jaccard_join, "similar_groups", lambda *args, **options: groups)
    monkeypatch.setattr(common, "written_bytes", lambda df: 1 << 40)
    kept = jaccard_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 100, 2))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
