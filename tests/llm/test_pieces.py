import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import pieces
from tallygrid.llm import textkit as T

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


def thue_morse(bits, a="a", b="b"):
    """Its complement has the same polynomial hash modulo 2**64 from 1024 letters on, whatever the base."""
    return "".join(b if i.bit_count() % 2 else a for i in range(1 << bits))


def texts():
    rnd = random.Random(11)
    odd = ["", None, " ", "  a  b ", "a" * 700, "▁literal ▁ mark", "\x00\x01\n\n\t ", "日本語テキスト ☃️ é", " " * 40 + "x" + " " * 19, "ﬁ Å x²", "<s> </s> <0x41>", "...!!!" * 60, "=" * 900, "\U0001f600\U0001f468‍\U0001f469"]
    odd += [thue_morse(n, *ab) for n in (10, 11) for ab in ("ab", "ba", "=-", "-=")] + [" ".join(f"w{k} long" for k in range(9000)), "twice", "twice"]
    alphabet = "etaoin shrdlu ETAOIN.,!?'\n\té日ñ0123456789-="
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(200)]


def test_equals_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    e = pieces.Encoder(pieces.model_file())
    e.TEXT, e.KEPT = 5000, 4000  # several suffix arrays, and chunks forgotten
    for part in (texts(), texts()[::-1], [" ".join(t for t in texts() if t)]):
        data, offsets = T.text_bytes(pa.array(part, pa.string()))
        ids, at = e.encode(data, offsets)
        raw, ends = e.decode(ids, at)
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == sp.encode(t or ""), repr(t)
            assert raw[ends[k] : ends[k + 1]].tobytes().decode() == (t or "").replace("▁", " ")


def test_query_columns(spark):
    rows = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts())], "doc_id long, text string, ids string")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    for r in pieces.digest(rows, pieces.model_file()).collect():
        t = texts()[r.doc_id] or ""
        want = sp.encode(t)
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()), "▁" not in t)
    assert pieces.digest(rows.limit(0), pieces.model_file()).count() == 0
