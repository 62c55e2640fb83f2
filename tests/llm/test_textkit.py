import numpy as np
import pytest

from tallygrid.llm import textkit as T


def laid(words):
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return data, np.concatenate([[0], ends[:-1]]), ends


def thue_morse(bits, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(1 << bits))


def test_span_hash_tells_texts_apart():
    words = ["", "a", "b", "ab", "ba", "aa", "a" * 63, "a" * 64, "a" * 65, "a" * 66, thue_morse(10), thue_morse(10, "b", "a"), thue_morse(11), thue_morse(11, "b", "a"), "é", "\0", "\0\0"]
    h = T.span_hash(*laid(words))
    assert len(set(h.tolist())) == len(words)
    assert (T.span_hash(*laid(words[::-1])) == h[::-1]).all()


@pytest.mark.parametrize("weak", [lambda d, a, z: (z - a).astype(np.uint64), lambda d, a, z: np.zeros(len(a), dtype=np.uint64)])
def test_equal_hashes_of_different_texts(monkeypatch, weak):
    monkeypatch.setattr(T, "span_hash", weak)
    words = ["ab", "cd", "ab", "ef", "abc", "", "cd", "", "ef", "xyz"]
    data, start, end = laid(words)
    key, first, number = T.distinct_spans(data, start, end)
    assert len(key) == len(set(words)) == len(set(number.tolist()))
    assert [words[first[n]] for n in number] == words
    kept = T.Kept(100)
    made = []

    def make(a, z):
        made.extend(data[i:j].tobytes().decode() for i, j in zip(a, z, strict=True))
        return np.repeat(a, z - a), np.concatenate([[0], np.cumsum(z - a)])

    for words in (words, ["cd", "xx", "ab"], ["yy"], ["xx", "yy", "ab"]):
        data, start, end = laid(words)
        lo, hi = kept.look_up(data, start, end, make)
        assert (hi - lo == end - start).all()
        texts = {}
        for w, a, z in zip(words, lo.tolist(), hi.tolist(), strict=True):
            assert texts.setdefault(w, (a, z)) == (a, z)
        assert len(set(texts.values()) - {(a, a) for a in range(1000)}) == len([t for t in texts if t])
