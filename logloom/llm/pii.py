"""Personal data: patterns with checks, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans.  The field's nodes are a document's words with a digit, ``@`` or ``+``; words without
any are fixed as "other".  Words that a base span touches are fixed to its kind.  Potentials: a word's shape (softmax regression),
neighbouring nodes, and skip edges between a word and the last word before it with the same (first SIMILAR) letters and digits, however far.
The words of numbers that share their last TAIL digits or more are joined as well, however they are spaced.
Loopy message passing over both kinds of edges carries a label to its distant repetitions and makes a document's labels agree.
All weights are learned here, by parts, from the base labels of a bounded sample of documents (``most_docs``).  What the patterns miss is not taught as "other": words
without a base label are unknown.  Those that a first regression cannot tell from labelled ones stay unknown and teach nothing; only the rest are "other".
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a row of digits begins: what follows the row does not depend on where in it one starts
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HOT = re.compile(r"[0-9@+]")
_EDGES = ".,;:!?\"'()[]{}<>"
LABELS = 1 + len(KINDS)
SIMILAR = 8


def emails(text: str):
    """The leftmost matches of local part, @ and dotted domain, found from each @ so that long words cost no more than once."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if not _HOT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _bucket(n: int, limits: tuple) -> int:
    return sum(n >= x for x in limits)


_DIGITS, _DOTS = (1, 4, 9, 13, 16, 17, 20), (1, 2, 3, 4)
FEATURES = 1 + 11 + len(_DIGITS) + 1 + len(_DOTS) + 1 + 2


def shape(word: str, before: bool, after: bool) -> list[int]:
    """Numbers of the features that a word has."""
    core = word.strip(_EDGES)
    digits = sum("0" <= c <= "9" for c in core)
    marks = ["@" in core, word.startswith("+") or core.startswith("+"), "(" in word or ")" in word, "-" in core, "=" in core, any(c.isalpha() for c in core), core.startswith("555-") or len(core) == 8 and core[3:4] == "-", digits == len(core)]
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    fits = quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    marks += [fits, quad and not fits, digits == len(core) and 13 <= digits <= 19 and core.isascii() and luhn(core)]
    on = [0] + [1 + i for i, m in enumerate(marks) if m]
    at = 1 + len(marks)
    on.append(at + _bucket(digits, _DIGITS))
    at += len(_DIGITS) + 1
    on.append(at + _bucket(core.count("."), _DOTS))
    at += len(_DOTS) + 1
    return on + [at] * before + [at + 1] * after


#: fixed values: last digits by which numbers of several words are alike, and the most digits of one
TAIL, LONGEST = 7, 19


class Graph:
    """The nodes of one document, their features, fixed labels and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        words = list(_WORD.finditer(text))
        hot = [i for i, m in enumerate(words) if _HOT.search(m[0])]
        self.spans = [words[i].span() for i in hot]
        self.place = hot
        near = set(hot)
        self.features = [shape(words[i][0], i - 1 in near, i + 1 in near) for i in hot]
        self.fixed = np.full(len(hot), -1)
        starts = np.array([a for a, _ in self.spans] or [0])
        for kind, a, b in base:
            i = max(0, int(np.searchsorted(starts, a, "right")) - 1)
            while i < len(hot) and self.spans[i][0] < b:
                if self.spans[i][1] > a:
                    self.fixed[i] = kind + 1
                i += 1
        self.chain = [(k, k + 1) for k in range(len(hot) - 1) if hot[k + 1] == hot[k] + 1]
        last: dict[str, int] = {}
        self.skip = []
        for k, i in enumerate(hot):
            name = "".join(c for c in words[i][0].lower() if c.isalnum() or c == "@")
            # alike: the same letters and digits, or as many of the first; the marks of '10.0.0.1' count for the least length
            if name and len(words[i][0].strip(_EDGES)) >= SIMILAR - 2:
                if (like := name[:SIMILAR]) in last:
                    self.skip.append((last[like], k))
                last[like] = k
        self.skip = sorted({*self.skip, *self._joined([words[i][0] for i in hot])})

    def _joined(self, words: list[str]) -> list[tuple[int, int]]:
        """Edges between the words of numbers that end alike, however they are spaced and whatever prefix they have."""
        digits = ["" if any(c.isalpha() or c == "@" for c in w) else "".join(c for c in w if "0" <= c <= "9") for w in words]
        edges, ends, last = [], {}, {}
        for k in range(len(words)):
            number, i = "", k
            while i >= 0 and digits[i] and len(number) < LONGEST and self.place[k] - self.place[i] == k - i:
                number = digits[i] + number
                i -= 1
            if len(number) < TAIL:
                continue
            ends[k] = number
            before = last.get(number[-TAIL:])
            last[number[-TAIL:]] = k
            if before is None:
                continue
            same = 0
            while same < min(len(number), len(ends[before])) and number[-1 - same] == ends[before][-1 - same]:
                same += 1
            i, j, a, b = k, before, 0, 0
            while a < same and b < same and i > before:  # words that share digits, from the right
                edges.append((j, i))
                to_a, to_b = a + len(digits[i]), b + len(digits[j])
                if to_a <= to_b:
                    i, a = i - 1, to_a
                if to_b <= to_a:
                    j, b = j - 1, to_b
        return edges


#: Weight of the examples that stand for other words with one feature.
PRIOR = 3.0


class Field:
    def __init__(self):
        self.unary = np.zeros((FEATURES, LABELS))
        self.unary[0, 0] = 3.0  # without any sample everything is "other"
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = 2.0 * np.eye(LABELS)

    @staticmethod
    def _regression(x: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
        y, w, total = np.eye(LABELS)[labels], np.zeros((FEATURES, LABELS)), max(weight.sum(), 1.0)
        for _ in range(steps):
            z = x @ w
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            w -= 2.0 * (x.T @ ((p - y) * weight[:, None]) / total + 1e-5 * w)
        return w

    def fit(self, graphs: list[tuple[list[list[int]], list[int], list, list]], steps: int = 1500, alike: float = 0.5) -> "Field":
        """Piecewise training: the regression on single words, the edges on pairs of labels.  Labels are -1 where the patterns say nothing.

        An unlabelled word that the first regression holds for data with a chance of ``alike`` or more stays unknown.
        """
        rows = [(f, y) for fs, ys, _, _ in graphs for f, y in zip(fs, ys)]
        if rows:
            x = np.zeros((len(rows), FEATURES))
            for i, (f, _) in enumerate(rows):
                x[i, f] = 1
            given = np.array([y for _, y in rows])
            # each feature alone, and with neighbours, has been seen on a few other words: one trait makes no data
            alone = np.repeat(np.eye(FEATURES), 2, axis=0)
            alone[:, 0] = 1
            alone[1::2, -2:] = 1
            x, given = np.concatenate([x, alone]), np.concatenate([given, np.zeros(len(alone), int)])
            weight = np.concatenate([np.ones(len(rows)), np.full(len(alone), PRIOR)])
            labels = np.maximum(given, 0)
            first = x @ self._regression(x, labels, weight, steps // 3)
            chance = np.exp(first - first.max(1, keepdims=True))
            chance = 1 - chance[:, 0] / chance.sum(1)
            known = (given > 0) | (chance < alike)
            self.unary = self._regression(x, labels, known * weight, steps)
            known = known[: len(rows)]
            pairs = np.ones((LABELS, LABELS)) * 0.5
            same = np.array([0.1, 40.0])  # differing and equal labels of words that are alike, before any is seen
            at = 0
            for _, ys, chain, skip in graphs:
                ok = known[at : at + len(ys)]
                at += len(ys)
                for a, b in chain:
                    if ok[a] and ok[b]:
                        pairs[max(ys[a], 0), max(ys[b], 0)] += 1
                for a, b in skip:
                    if ys[a] > 0 and ys[b] > 0:  # one label missing says nothing of the other
                        same[int(ys[a] == ys[b])] += 1
            joint = pairs / pairs.sum()
            self.chain = np.clip(np.log(joint) - np.log(np.outer(joint.sum(1), joint.sum(0))), -3, 3)
            self.skip = np.clip(np.log(same[1] / same[0]), 3.0, 6.0) * np.eye(LABELS)
        return self

    def marginals(self, g: Graph, rounds: int = 20) -> np.ndarray:
        """Label probabilities by loopy sum-product messages, both ways over all edges at once, damped."""
        n = len(g.spans)
        local = np.array([self.unary[f].sum(0) for f in g.features])
        given = g.fixed >= 0
        local[given] = -50.0
        local[given, g.fixed[given]] = 0.0
        edges = g.chain + g.skip
        if edges:
            a, b = np.array(edges).T
            pot = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            msg = np.zeros((2 * len(a), LABELS))
            for _ in range(rounds):
                belief = local.copy()
                np.add.at(belief, target, msg)
                out = (belief[source] - msg[back])[:, :, None] + pot
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                change = np.abs(new - msg).max()
                msg = 0.5 * msg + 0.5 * new
                if change < 1e-4:
                    break
            np.add.at(local, target, msg)
        local -= local.max(1, keepdims=True)
        p = np.exp(local)
        return p / p.sum(1, keepdims=True) if n else p

    def added(self, text: str, base: list[tuple[int, int, int]], sure: float = 0.5) -> list[tuple[int, int, int]]:
        """Spans that the field finds beside the base spans; neighbouring words of one kind make one."""
        if not _HOT.search(text):
            return []
        g = Graph(text, base)
        if not (g.fixed < 0).any():
            return []
        p = self.marginals(g)
        out, last = [], None
        for i in np.flatnonzero((g.fixed < 0) & (p.argmax(1) > 0) & (p.max(1) >= sure)).tolist():
            a, b = g.spans[i]
            word = text[a:b]
            a += len(word) - len(word.lstrip(_EDGES))
            b -= len(word) - len(word.rstrip(_EDGES))
            kind = int(p[i].argmax()) - 1
            if b <= a or any(x < b and a < y for _, x, y in base):
                continue
            if last == (kind, g.place[i] - 1):
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
            last = (kind, g.place[i])
        return out


def spread(graph: Graph, most: int, stretch: int = 20) -> tuple[list[list[int]], list[int], list[list[int]], list[list[int]]]:
    """Features, labels (-1: unknown), chain and skip edges of at most ``most`` words: all, or stretches of neighbours spread over the whole text."""
    n = len(graph.spans)
    kept = np.arange(n)
    if n > most:
        begins = np.linspace(0, n - stretch, max(1, most // stretch)).astype(int)
        kept = np.unique((begins[:, None] + np.arange(stretch)).ravel())[:most]
    new = {int(k): i for i, k in enumerate(kept)}
    edges = [[[new[a], new[b]] for a, b in e if a in new and b in new] for e in (graph.chain, graph.skip)]
    return [graph.features[k] for k in kept], graph.fixed[kept].tolist(), *edges


def train(docs: DataFrame, text_col: str = "text", most_docs: int = 600, most_words: int = 200) -> Field:
    """Learn from the base labels of ``most_docs`` documents in hash order; at most ``most_words`` words of each come to the driver, spread over its text."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@+]")).withColumn("h", F.xxhash64("text"))
    chosen = [r.h for r in texts.select("h").distinct().orderBy("h").limit(most_docs).collect()]

    def run(stream):
        import pyarrow as pa

        for batch in stream:
            rows = [spread(Graph(text, base_spans(text)), most_words) for text in batch.column("text").to_pylist()]
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pairs if i != 1 else pa.list_(pa.int64())) for i in range(4)], ["f", "y", "chain", "skip"])

    some = texts.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).select("text")
    rows = some.mapInArrow(run, "f array<array<bigint>>, y array<bigint>, chain array<array<bigint>>, skip array<array<bigint>>").collect()
    rows.sort(key=lambda r: (r.f, r.y))
    return Field().fit([(r.f, r.y, r.chain, r.skip) for r in rows])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, text_col: str = "text", field: Field | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and a struct of the spans found in every row's text: ``base`` and ``spans`` (base and added), by kind, then start.

    Null and empty texts hold nothing; repeated rows are searched each; an empty table gives no rows; the struct is
    the last column, named ``pii`` or, if there is such a column, longer.
    """
    field = field or train(docs, text_col)
    wanted = keep or docs.columns
    rows = docs.select(*dict.fromkeys([*wanted, text_col]))
    names, out = rows.columns, free_name(docs, "pii")
    at = names.index(text_col)

    def run(stream):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        spans = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found]
        for batch in slices(stream):
            base, whole = [], []
            for text in batch.column(at).to_pylist():
                first = base_spans(text) if text else []
                base.append(spans(first))
                whole.append(spans(sorted(first + (field.added(text, first) if text else []))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(base, kind), pa.array(whole, kind)], ["base", "spans"])], [*names, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StructType([T.StructField("base", SPAN), T.StructField("spans", SPAN)]))])
    return rows.mapInArrow(run, schema).select(*wanted, out)


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        parts += [text[at : max(a, at)], f"[{kind.upper()}]"] if a >= at else []
        at = b
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; nulls stay null.  Spans are found and replaced by the same Python worker."""
    field = field or train(docs, text_col)
    at, names = docs.columns.index(text_col), docs.columns

    def run(stream):
        import pyarrow as pa

        for batch in slices(stream):
            texts = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                spans = base + field.added(text, base) if text else []
                texts.append(mask_text(text, [(a, b, KINDS[k]) for k, a, b in spans]) if spans else text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    text = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("pii.base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("pii.base"), 256).alias("base_sha256"), text("pii.spans").alias("spans"))
