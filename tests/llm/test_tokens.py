import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from logloom.llm import packing, pieces, token_binary, token_counts  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, ids int"


def texts(n=60, seed=5):
    g = random.Random(seed)
    parts = ["the", "Été", " ", " ", " ", "  ", "\n", ", ", ". ", ".\n", "'s", "\t", "1234", "　", "x", "<|endoftext|>", "!", "#,", "\0", "日本", "é", "\x1c", "İ", "\u0307", "İ. ", "İ, ", "END!! ", "***", "plain words here", "other, words."]
    return ["".join(g.choice(parts) for _ in range(g.randrange(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", 1) for i, t in enumerate(texts())] + [(100, None, None, 1), (101, "", "s0", 1), (7, "again", "s1", 1), (7, "again", "s1", 1), (None, "no id", "s2", 1), (102, "word " * 3000, "s1", 1)]
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_plain_encoding(path):
    encoder, plain = pieces.PieceEncoder(path, most_pieces=50), pieces.load(path)
    for _ in range(2):
        for t, ids in zip(texts(400), encoder.encode(texts(400))):
            assert np.frombuffer(ids, encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert encoder.direct


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_signs_beside_every_latin_letter(path):
    encoder, plain = pieces.PieceEncoder(path), pieces.load(path)
    for c in map(chr, range(0x250)):
        for t in (f"a{c}. b", f"{c}, b", f"{c}.\nb", f"a {c}a, b", f"x {c}", f"{c}{c}.", f"x {c}!?,", f"{c}'s {c}'"):
            assert np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_ranks_round_trip(n):
    g = np.random.default_rng(n)
    ranks = (g.integers(0, 1 << 32, n, dtype=np.uint64) >> g.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
    control, data = token_binary.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and (token_binary.decode_ranks(control, data, n) == ranks).all()


def test_token_binary(docs):
    rows, df = docs
    plain = pieces.load(BYTE)
    want, at = defaultdict(list), 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i].append((at, len(ids), ids.tobytes()))
        at += len(ids)
    got = defaultdict(list)
    for r in token_binary.encode_documents(df, BYTE).collect():
        got[r.doc_id].append((r.start, r.n_tokens, bytes(r.ids)))
    assert {k: sorted(v) for k, v in got.items()} == want
    digest = token_binary.encode_documents(df.filter("doc_id = 101"), BYTE, digest=True).collect()
    assert [tuple(r) for r in digest] == [(101, 0, 1, zlib.crc32(bytes(4)))]


def test_token_counts(docs):
    rows, df = docs
    plain = pieces.load(BYTE)
    for huge, chunk, overlap in ((48_000, 16_384, 256), (80, 200, 90)):
        got = sorted(token_counts.count_tokens(df, BYTE, 30, huge, chunk, overlap).collect(), key=repr)
        want = [(i, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 30) for i, t, *_ in rows]
        assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(token_counts_row(r)))


def token_counts_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], n_bytes=r[1], n_tokens=r[2], over_limit=r[3])


def test_overlaps_widen(spark):
    """Texts without a word boundary end as one chunk; digits and letters that never break need wider overlaps."""
    rows = [(1, "a" * 3000), (2, ("b" * 700 + " ") * 6), (3, "'re" * 900), (4, " " * 2500 + "x")]
    plain = pieces.load(BYTE)
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, huge=300, chunk=256, overlap=80).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in rows}


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.1}])
def test_packing(docs, targets):
    rows, df = docs
    plain = pieces.load(WORD)
    want = sorted(np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t, *_ in rows)
    found = packing.pack(df, WORD, size=64, targets=targets).collect()
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append(r)
    total = sum(r.length for r in found)
    assert total == sum(len(w) // 4 for w in want) and set(windows) == set(range(-(-total // 64)))
    for w, parts in windows.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or w == max(windows)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t, *_ in rows:
        if i != 7:
            ids, at = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
            for start, n, crc, all_of in sorted(by_doc[i]):
                assert (start, crc, all_of) == (at, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
                at += n
            assert at == len(ids)


def test_shares_follow_targets():
    """Every full window is within one token of every queue's share, until a queue runs dry."""
    s = packing.Schedule([500_000, 300_000, 40_000], [0.5, 0.3, 0.2], 4096)
    window, count, queues, _, shares, _ = s.phases[0]
    assert queues == [0, 1, 2] and sum(shares) == packing.UNIT
    _, quota, _ = packing._pattern(tuple(shares), 4096)
    assert (quota.sum(1) == 4096).all() and (abs(quota - 4096 * np.array(shares) / packing.UNIT) < 2).all()
    for q, total in enumerate((500_000, 300_000, 40_000)):
        cut = np.concatenate(s.cut(q, 0, total), axis=1)
        assert cut[0][0] == 0 and cut[1][-1] == total and (cut[0][1:] == cut[1][:-1]).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert token_binary.encode_documents(empty, BYTE).count() == 0
    assert token_counts.count_tokens(empty, BYTE).count() == 0
    assert packing.pack(empty, WORD).count() == 0


def test_packing_of_equal_rows(spark):
    """Equal rows are documents of their own: they lie one behind the other without a gap, whatever the number of partitions."""
    rows = [(None, "the same words again", "s")] * 300 + [(5, None, None)] * 40 + [(i, f"number {i}", "t") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for n in (1, 7):
        found = packing.pack(df.repartition(n), WORD, size=32).collect()
        seen.append(sorted((r.sequence_id, r.offset, r.length, str(r.doc_id), r.start, r.ids_crc32, r.doc_tokens) for r in found))
        at = 0
        for window, offset, length, *_ in seen[-1]:
            assert (window, offset) == divmod(at, 32)
            at += length
        assert at == sum(r.doc_tokens for r in found if r.start == 0)
    assert seen[0] == seen[1]


def test_memory_for_pieces_is_as_asked_for():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert pieces.PieceEncoder.of(path, 7).inside.most == 7
    assert pieces.PieceEncoder.of(path).inside.most == 500_000
    pieces.forget()


def test_packing_remembers_rare_pieces(spark, docs, monkeypatch):
    asked, encode = [], pieces.encode_rows
    monkeypatch.setattr(pieces, "encode_rows", lambda path, text, keep, end, most=0: asked.append(most) or encode(path, text, keep, end, most))
    assert packing.pack(docs[1], WORD, size=64).count() and asked == [1_000_000]
