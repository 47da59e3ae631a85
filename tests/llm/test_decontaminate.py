"""Benchmark items in documents, against all items x all texts x all shifts in plain Python."""

import random

import regex

from logloom.llm import decontaminate
from logloom.llm.decontaminate import DRIFT, LITERALS, PIECE, UNITS, WINDOW

TOKEN = regex.compile(r"[^\x20\x09-\x0D]+")
NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,:/][0-9]+)*"


def parts(text):
    """``(template, raw)`` words: numbers, units behind numbers and names inside sentences are marks; a run of names, or a number with its units, is one."""
    t = regex.sub(NUMBER, "\1", text)
    units = "|".join(sorted(map(regex.escape, UNITS), key=len, reverse=True))
    t = regex.sub(rf"(?<=\x01[\x20\x09-\x0D-])(?:square|cubic|sq|cu)(?=[\x20\x09-\x0D](?:{units})(?![\p{{L}}\p{{N}}]))", "\2", t)
    t = regex.sub(rf"(?<=\x01|\x01[\x20\x09-\x0D-]|\x02[\x20\x09-\x0D])(?:{units}|%)(?![\p{{L}}\p{{N}}])", "\2", t)
    t = regex.sub(r"(?<=[^.!?:\x20\x09-\x0D][\x20\x09-\x0D])\p{Lu}[\p{L}'’-]*", "\3", t).lower()
    out = []
    for word, raw in zip(TOKEN.findall(t), TOKEN.findall(text), strict=True):
        before = out[-1][0] if out else ""
        # a mark joins what stands before it only where nothing but spaces is between
        if before.endswith("\3") and word.startswith("\3"):
            out[-1] = (before + word[1:], out[-1][1] + " " + raw)
        elif before.endswith(("\1", "\2")) and word.startswith("\2"):
            out[-1] = (before[:-1] + "\2" + word[1:], out[-1][1] + " " + raw)
        else:
            out.append((regex.sub("\1[ -]?\2", "\2", word), raw))
    return [w for w, _ in out], [r for _, r in out]


def slot(word):
    return any(m in word for m in "\1\2\3")


def run_end(words, i):
    """End of the shortest run from ``i`` on with enough words and literal ones; None where there is none."""
    literal = [k for k in range(i, len(words)) if not slot(words[k])]
    end = max(i + WINDOW, literal[LITERALS - 1] + 1) if len(literal) >= LITERALS else None
    return end if end and end <= len(words) else None


def score(item, doc, shift):
    (words, raw), (dwords, draw) = item, doc
    n = len(words)
    inside = lambda j: 0 <= j < len(dwords)
    alike = lambda i, d: 0 <= i < n and inside(i + shift + d) and (words[i] == dwords[i + shift + d] or raw[i].lower() == draw[i + shift + d].lower())
    piece = lambda i, d: any(all(alike(k, d) for k in range(i - a, i - a + PIECE)) for a in range(PIECE))
    straight = [0 if alike(i, 0) else None for i in range(n)]
    near = [0 if alike(i, 0) else next((d for d in sorted(range(-DRIFT, DRIFT + 1), key=abs) if d and piece(i, d)), None) for i in range(n)]

    def taken(i):
        for k in range(max(0, i - 2 * DRIFT), min(n, i + 2 * DRIFT + 1)):
            if k != i and near[k] is not None and (abs(near[k]), k) < (abs(near[i]), i):
                here, there = i + near[i], k + near[k]
                if (there >= here) if k < i else (there <= here):
                    return True
        return False

    ordered = [d if d is not None and not taken(i) else None for i, d in enumerate(near)]
    best = 0
    for off in (straight, ordered):
        fills = {}
        for i, d in enumerate(off):
            if d is not None and slot(words[i]):
                fills.setdefault(raw[i], []).append(draw[i + shift + d])
        got = sum(d is not None and not slot(words[i]) for i, d in enumerate(off)) + sum(len(v) for v in fills.values() if len(set(v)) == 1)
        if got >= min(WINDOW, n) and (got >= 0.5 * n or got >= 13):
            best = max(best, got)
    return best


def brute(docs, items):
    found = {}
    cut = {d: parts(t) for d, t in docs if t}
    for item_id, text in items:
        plain = TOKEN.findall(text.lower())
        item = parts(text)
        words, raw = item
        thin = len(words) < WINDOW or sum(not slot(w) for w in words) < LITERALS
        ends = [(i, e) for i in range(len(words)) if (e := run_end(words, i))]
        by_value = sum(not slot(w) for w in words) < LITERALS
        for d, t in docs:
            if not t or not words:
                continue
            if len(plain) < WINDOW:
                have = TOKEN.findall(t.lower())
                if any(have[i : i + len(plain)] == plain for i in range(len(have))):
                    found[d, item_id] = len(plain)
                continue
            dwords, draw = cut[d]
            for shift in range(-len(words), len(dwords)):
                if thin:
                    mine, theirs = (raw, draw) if by_value else (words, dwords)
                    met = shift >= 0 and theirs[shift : shift + len(mine)] == mine
                else:
                    met = any(i + shift >= 0 and words[i:e] == dwords[i + shift : e + shift] for i, e in ends)
                if met and (got := score(item, (dwords, draw), shift)):
                    found[d, item_id] = max(got, found.get((d, item_id), 0))
    return found


def planted(seed, n):
    """Items and documents that ask them again: other values, values of other lengths, a word changed, put in or left out, parts; few literal words."""
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefghijklm") for _ in range(g.randrange(3, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    name = lambda: " ".join(word().capitalize() for _ in range(g.choice([1, 1, 2, 3])))
    number = lambda: g.choice([str(g.randrange(2, 99)), f"{g.randrange(2, 9)}.{g.randrange(9)}", f"{g.randrange(2, 99)} {g.choice(['km', 'square km', 'kg', 'hours', '%'])}"])
    shapes = [[g.choice([word(), word(), word(), "NAME", "NUMBER"]) for _ in range(g.randrange(14, 30))] for _ in range(n)]
    # questions with few literal words
    for i in range(0, n, 10):
        shapes[i] = ["what", "is", *g.choice([["NUMBER", "plus", "NUMBER", "times", "NUMBER", word()], ["NAME", word(), "NUMBER", word(), "NAME"]]), word()]
    fill = lambda shape: " ".join(name() if w == "NAME" else number() if w == "NUMBER" else w for w in shape)
    items = [(i, fill(s)) for i, s in enumerate(shapes)]
    docs = []
    for i, s in enumerate(shapes):
        s = list(s)
        if i % 10 and i % 3 == 1:
            at = g.randrange(2, len(s) - 2)
            s[at : at + g.choice([0, 1])] = g.choice([[word()], []])
        docs.append((i, f"{prose(g.randrange(5, 40))} {fill(s)} {prose(g.randrange(5, 40))}"))
    docs += [(10_000 + i, f"{prose(40)} {name()} {prose(9)} {number()} {prose(9)}") for i in range(n // 4)]
    return items, docs


def told(spark, docs, items):
    rows = decontaminate.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.matched for r in rows.collect()}


def test_equal_to_brute_force(spark):
    items, docs = planted(5, 60)
    items += [(900, "why not"), (901, "Ask Tom now"), (902, "7 %"), (903, "sum 3 5 7 11 13 17")]
    docs += [(20_000, "and Why NOT he said"), (20_001, "please ask tom now"), (20_002, "it is 7 % then"), (20_003, "it is 8 % then why nots"), (20_004, "sum 3 5 7 11 13 17 and sum 4 5 7 11 13 17"), (20_005, None), (20_006, "")]
    want = brute(docs, items)
    assert told(spark, docs, items) == want
    assert {(20_000, 900), (20_001, 901), (20_002, 902), (20_004, 903)} == {k for k in want if k[0] >= 20_000}


def test_recall_of_two_hundred_questions(spark):
    items, docs = planted(8, 240)
    found = told(spark, docs, items)
    hits = sum((i, i) in found for i in range(240))
    assert hits >= 0.9 * 240 and not [k for k in found if k[0] >= 10_000]


def test_odd_tables(spark):
    """Columns with the operator's own names, no benchmark, no documents, many alignments in one long text, rows that are there twice."""
    item = "one two three four five six seven eight"
    text = " ".join([item] * 2000)
    docs = spark.createDataFrame([(1, text, "a", 2, True), (1, text, "b", 3, None), (2, "clean words only", None, None, None), (None, None, None, None, None)], "doc_id long, text string, key string, hash long, _hit boolean")
    items = spark.createDataFrame([(7, item, "m"), (7, item, "m"), (8, None, None)], "item_id long, text string, words string")
    rows = decontaminate.leaked(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.slots, r.item_words) for r in rows] == [(1, 7, 8, 0, 8)] * 2
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "None"]
    assert decontaminate.clean(docs, items.limit(0)).count() == 4 and decontaminate.clean(docs.limit(0), items).count() == 0


def test_runs_have_the_hash_of_their_words(spark):
    """Whatever their length, so that runs of items and documents meet."""
    from pyspark.sql import functions as F

    rows = ["a \1 \2 \3 b c d e \1 f", "\1 \1 \1 a b", "a b c", "", "\1", "a \1 b \1 c \1 d \1 e \1", "a b c d e", "a b c d e f a b c d e"]
    words = [r.split() for r in rows]
    df = spark.createDataFrame(list(enumerate(words)), "n int, w array<string>").repartition(2)
    got = {(r.n, r.f.at): r.f.hash for r in df.select("n", F.explode(decontaminate.windows(F.col("w"))).alias("f")).collect()}
    runs = [(n, i, w[i:e]) for n, w in enumerate(words) for i in range(len(w)) if (e := run_end(w, i))]
    want = {(r.n, r.i): r.h for r in spark.createDataFrame(runs, "n int, i int, w array<string>").select("n", "i", F.xxhash64("w").alias("h")).collect()}
    assert want and {k: h for k, h in got.items() if h is not None} == want
