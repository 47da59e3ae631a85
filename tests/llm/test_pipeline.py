import random

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from logloom.llm import queries  # noqa: E402


def test_names():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "pii", "packing"]


def test_stages(spark, tmp_path):
    g = random.Random(6)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    rows = [(i, prose(60)) for i in range(30)]
    rows += [(40, rows[0][1]), (41, rows[1][1] + " tail"), (42, "junk"), (43, "same same same same same " * 20), (44, prose(20) + " " + item + " " + prose(20)), (45, "mail me at someone@mail.example.com " + prose(40)), (46, None)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/out{n}")
        docs = spark.read.parquet(f"{d}/out{n}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert ids("quality_rules") == {*range(30), 40, 41, 44, 45}
    assert ids("jaccard_join") == {*range(30), 44, 45}
    assert ids("decontamination") == {*range(30), 45} == ids("pii") == ids("packing")
    masked = seen["pii"].filter("doc_id = 45").first()
    assert masked.text.startswith("mail me at [EMAIL] ") and masked.n_chars == len(masked.text)
    whole = {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in seen["packing"].collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, verdict int, pii string, _row_key int"


def test_empty_table(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a very long text and columns with the operators' own names pass every stage."""
    g = random.Random(9)
    prose = lambda n: " ".join("".join(g.choice("abcdefghijklmnop") for _ in range(g.randrange(2, 8))) for _ in range(n))
    item, again, long = prose(20), prose(50), prose(60_000)
    rows = [(1, prose(40), "s"), (None, prose(40), None), (2, again, "s"), (2, again, "s"), (3, None, "s"), (4, "", None), (5, long, "t"), (6, f"{prose(9)} {item} {prose(9)}", "t"), (7, f"{prose(30)} a.b@c.dd", None)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y", 2) for i, t, s in rows], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = [{1, None, 2, 5, 6, 7}, {1, None, 2, 5, 6, 7}, {1, None, 2, 5, 7}, {1, None, 2, 5, 7}]
    for n, ((_, stage), ids) in enumerate(zip(corpus_pipeline.STAGES, want)):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/out{n}")
        docs = spark.read.parquet(f"{d}/out{n}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids and docs.count() == len(ids) + (n == 0)
    assert docs.filter("doc_id = 7").first().text.endswith(" [EMAIL]") and docs.filter("doc_id = 5").first().text == long
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == want[-1] and {r.sequence_id for r in pieces} == set(range(1 + max(r.sequence_id for r in pieces)))
