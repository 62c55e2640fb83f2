import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import bitpack as B

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("bits", [1, 7, 12, 16, 17, 20])
def test_round_trip_and_random_access(bits):
    rnd = np.random.default_rng(bits)
    sizes = rnd.integers(0, 3000, 20)
    ids = rnd.integers(0, 1 << bits, sizes.sum()).astype(np.int64)
    f = B.PackedFile(B.write_file(np.arange(20) * 3, sizes, ids, bits))
    assert f.bits == bits and f.doc_ids.tolist() == list(range(0, 60, 3))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for k in rnd.permutation(20):
        assert f.document(k).tolist() == ids[starts[k] : starts[k + 1]].tolist()
    lo, hi = sorted(rnd.integers(0, len(ids), 2))
    assert f.ids(lo, hi).tolist() == ids[lo:hi].tolist()


def thue_morse(bits, a="a", b="b"):
    """Its complement has the same polynomial hash modulo 2**64 from 1024 letters on, whatever the base."""
    return "".join(b if i.bit_count() % 2 else a for i in range(1 << bits))


def texts():
    rnd = random.Random(3)
    odd = [None, "", "it's 12,345 naïve”, ''s 'tis don't.'re", "İ é́ \u0085x", "<|endoftext|> a", "   \t\n", "日本語123ß'll", "x" * 30000, "a b " * 5000, "\x00\x01\x7f"]
    odd += [thue_morse(n, *ab) for n in (10, 11) for ab in ("ab", "ba")]
    return odd + ["".join(rnd.choice("aAbé. ,'\n1日") for _ in range(rnd.randint(0, 200))) for _ in range(80)]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_library(spark, monkeypatch, file):
    monkeypatch.setattr(B, "FILE_IDS", 500)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(3 * k, t, "x") for k, t in rows], "doc_id long, text string, start string")
    got = sorted(map(tuple, B.read_files(B.write_files(docs, P.path(file), shards=3)).collect()))
    t = tokenizers.Tokenizer.from_file(P.path(file))
    start, want = 0, []
    for k, text in enumerate(texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((3 * k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_repeated_and_null_ids(spark):
    far = (1 << 53) + 1
    rows = [(2, "a b"), (1, "c"), (None, "n n n"), (2, "d"), (2, "a b"), (far, "e"), (None, None), (-(1 << 63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "file", "ids", "absent")})
    for shards in (1, 3):
        got = sorted(B.read_files(B.write_files(docs, P.path("word_bpe_49k.json"), shards=shards)).select("doc_id", "start", "n_tokens").collect(), key=lambda r: r.start)
        sizes = [r.n_tokens for r in got]
        assert [r.doc_id for r in got] == [None, None, -(1 << 63), 1, 2, 2, 2, far] and [r.start for r in got] == [sum(sizes[:k]) for k in range(len(rows))]


def test_pieces_that_a_tokenizer_splits_are_encoded_apart(monkeypatch):
    e = B.PieceEncoder(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(B.PieceEncoder, "_single", staticmethod(lambda piece: True))
    ids, offsets = e.pieces(["ab", "12", "don't"])
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:], strict=False)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab", "12", "don't")]


def test_a_tokenizer_that_keeps_case_is_encoded_whole(tmp_path):
    import json

    spec = json.loads(tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")).to_str())
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    e = B.PieceEncoder(str(tmp_path / "cased.json"))
    assert not e.by_piece and B.PieceEncoder(P.path("word_bpe_49k.json")).by_piece
    data = np.frombuffer(b"Some Words", dtype=np.uint8)
    assert e.encode(data, np.array([0, 10]))[0].tolist() == e.tokenizer.encode("Some Words", add_special_tokens=False).ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.read_files(B.write_files(docs, P.path("word_bpe_49k.json"), shards=2)).count() == 0
