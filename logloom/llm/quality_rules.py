"""Quality rules of documents and of hosts.

Each document is measured and held against rules.  Rule failures are then counted for each host; a host's rate is shrunk towards
the rate of all hosts with a beta prior that is fitted to the hosts' rates, so that a host with few documents is not judged by
chance; hosts whose shrunk rate of a rule lies far beyond what the prior holds for likely reject all their documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, left_join_sized, saved, slices, table, tidy

WINDOW = 5
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: rule -> failed, as a column over the measures.  The first two alone reject a document.
RULES = {
    "short": lambda m: m["n_words"] < 10,
    "repeat": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["word_chars"],
    "lines": lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"],
}
BASE_RULES = ("short", "repeat")
#: Documents that the prior is worth at most: it steadies small hosts, and does not talk large ones out of their own rates.
MOST_WORTH = 50.0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == n:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    keys = (windows * _ODD).sum(1, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    pairs = np.flatnonzero(same)
    if (windows[order[pairs]] != windows[order[pairs + 1]]).any():  # keys that clash: compare the windows themselves
        _, back, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        found = np.flatnonzero(counts[back.reshape(-1)] > 1)
    else:
        found = np.union1d(order[pairs], order[pairs + 1])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    return len(words), len(text) - spaces, len(data) - len(data.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """``docs`` with a struct of the measures; a null text has no words."""
    names = docs.columns
    at = names.index(text_col)

    def run(stream):
        import pyarrow as pa

        for batch in slices(stream):
            rows = [measure_text(t or "") for t in batch.column(at).to_pylist()]
            fields = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, MEASURES)], [*names, out])

    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def beta_prior(hosts: DataFrame, failed: str, total: str, rounds: int = 5) -> tuple[float, float]:
    """The beta prior fitted to the hosts' rates by moments: their spread beyond what chance gives at their sizes.

    Hosts that lie far above the fit would widen it until they looked likely, so they are left out and it is fitted again.  One row a round comes to the driver.
    """
    k, n = F.col(failed), F.col(total)
    rows, seen, prior = hosts, None, (1.0, 1.0)
    for _ in range(rounds):
        s = rows.agg(F.sum(k).alias("k"), F.sum(n).alias("n"), F.count("*").alias("hosts"), F.sum(k * k / n).alias("kk")).first()
        if not s.n or s.hosts == seen:
            break
        seen = s.hosts
        mean = (s.k + 0.5) / (s.n + 1.0)
        spread = max(s.kk / s.n - (s.k / s.n) ** 2, 0.0) - mean * (1 - mean) * s.hosts / s.n
        strength = mean * (1 - mean) / spread - 1 if spread > 1e-9 else 1e6
        strength = min(max(strength, 2.0), MOST_WORTH)
        prior = mean * strength, (1 - mean) * strength
        chance = F.sqrt(F.lit(mean * (1 - mean)) * (1 / F.lit(strength + 1) + 1 / n))
        rows = hosts.filter(k / n <= F.lit(mean) + 2 * chance)
    return prior


def likely_most(a: float, b: float, times: float = 3.0, deviations: float = 6.0, ceiling: float = 0.5) -> float:
    """The rate beyond which a host is no likely draw from the prior: so many times its mean and so many of its standard deviations above it, or the ceiling."""
    mean = a / (a + b)
    return min(max(times * mean, mean + deviations * (mean * (1 - mean) / (a + b + 1)) ** 0.5), ceiling)


def bad_hosts(rows: DataFrame, measures: str, host_col: str, limit: float | None) -> DataFrame:
    """One row for each host that a rule rejects, with its worst shrunk rate.  Documents are counted in their own tasks first; a null host is none."""
    m = F.col(measures)
    counts = [F.sum(rule(m).cast("long")).alias(name) for name, rule in RULES.items()]
    hosts = saved(rows.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *counts), "hosts")
    found = []
    for name in RULES:
        a, b = beta_prior(hosts, name, "n")
        rate = (F.col(name) + F.lit(a)) / (F.col("n") + F.lit(a + b))
        found.append(F.struct((rate / F.lit(limit or likely_most(a, b))).alias("excess"), rate.alias("rate")))
    worst: Column = F.greatest(*found) if len(found) > 1 else found[0]
    return hosts.select("host", worst.alias("worst")).filter(F.col("worst.excess") > 1).select("host", F.col("worst.rate").alias("host_rate"))


@tidy
def rejected_hosts(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float | None = None) -> DataFrame:
    """``host, host_rate`` of the hosts that a rule rejects (``limit``: a fixed rate in place of the prior's); only measures are written, no texts."""
    out, host = free_name(docs, "measures"), free_name(docs, "_host")
    rows = measured(docs.select(F.col(host_col).cast("string").alias(host), F.col(text_col).alias(text_col)), text_col, out)
    return bad_hosts(saved(rows.select(host, out), "measured"), out, host, limit)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row of ``docs`` (all by default) and a struct ``verdict``: the measures, ``base_failed``, ``host_failed``, ``kept``.

    Texts are measured once and the measures written, for the hosts and for the documents; only where the texts themselves are kept are they measured twice, so that they are not written.  Null and empty texts have no words and fail; a null host has no
    verdict; repeated rows are judged each; an empty table gives no rows; a column of ``docs`` that is named like the
    struct only lengthens the struct's name (it is the last column).
    """
    wanted = keep or docs.columns
    out, host, rate = (free_name(docs, n) for n in ("verdict", "_host", "host_rate"))
    rows = measured(docs.select(*dict.fromkeys([*wanted, host_col, text_col])), text_col, out).withColumn(host, F.col(host_col).cast("string")).select(*wanted, host, out)
    if text_col in wanted:
        bad = rejected_hosts(docs, host_col, text_col, limit)
    else:
        rows = saved(rows, "measured")
        bad = saved(bad_hosts(rows, out, host, limit), "rejected")
    judged = left_join_sized(rows, bad.select(F.col("host").alias(host), F.col("host_rate").alias(rate)), [host])
    m = F.col(out)
    base = RULES["short"](m) | RULES["repeat"](m)
    failed = F.col(rate).isNotNull()
    verdict = F.struct(*[m[x].alias(x) for x in MEASURES], base.alias("base_failed"), failed.alias("host_failed"), (~base & ~failed).alias("kept"))
    return judged.select(*wanted, verdict.alias(out))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    judged = judge(docs, **options)
    verdict = judged.columns[-1]
    return judged.filter(F.col(f"{verdict}.kept")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    v = F.col("verdict")
    return judged.select("doc_id", *[v[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")])
