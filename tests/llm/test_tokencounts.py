import base64
import functools
import re
from collections import Counter

import pyarrow as pa
import pytest
import regex

from tallygrid.llm import textkit as T
from tallygrid.llm import tokencounts as C

public_tokenizers = pytest.importorskip("public_tokenizers")


@functools.cache
def ranks(version):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(version), "rb"))}


@functools.cache
def tokens_of(version, part):
    """Merging by rank, from the definition."""
    known, tokens = ranks(version), [bytes([x]) for x in part.encode()]
    while len(tokens) > 1:
        best = min(range(len(tokens) - 1), key=lambda k: known.get(tokens[k] + tokens[k + 1], 1 << 40))
        if tokens[best] + tokens[best + 1] not in known:
            break
        tokens[best : best + 2] = [tokens[best] + tokens[best + 1]]
    return len(tokens)


def brute_count(version, text):
    return sum(tokens_of(version, part) for part in regex.findall(public_tokenizers.PATTERN, text))


def rows():
    base = [(k, f"Hello number {k}, mail me@example{k}.org now" if k % 3 else f"plain text {k} " * (k + 1), ["en", "de", None][k % 3], f"src{k % 2}") for k in range(40)]
    return [*base, (100, None, "en", "src0"), (101, "", "en", None), (7, base[7][1], base[7][2], base[7][3]), (102, "long " * 20000, "en", "src0")]


def brute(rows, gone):
    total = Counter()
    for d, t, lang, source in rows:
        t = re.sub(C.EMAIL, "<email>", t or "")
        if d not in gone:
            for v in C.VERSIONS:
                for name, n in zip(C.SUMS, (1, brute_count(v, t), len(t.encode())), strict=True):
                    total[source, lang, v, name] += n
    return +total


def got(df):
    return +Counter({(r.source, r.lang, r.tokenizer, c): r[c] for r in df.collect() for c in C.SUMS})


TEXTS = ["", " ", "  a", "a b", "a  b", "a \n b", "it's we'll I'M ' s", "é è  à", "a\u00a0 b", "a \u00a0b", "\u3000 x \u2003 y\u2003", "x \u0085 y", "tab\tb c\x7f d \x1c e", "12 34  5,6 ,7 !!", "ünï côdé ß 漢字 かな", "trailing ", "a " * 50, "e\u0301 o"]


def test_counts_equal_the_definition():
    texts = [*TEXTS, *(a + b for a in TEXTS for b in TEXTS), None]
    data, offsets = T.text_bytes(pa.array(texts, pa.string()))
    counter = C.Counter(C.VERSIONS)
    for _ in range(2):  # met and kept
        got = counter.count(data, offsets)
        assert got.tolist() == [[brute_count(v, t or "") for v in C.VERSIONS] for t in texts]
    counter.KEPT = counter.kept.most = 10
    assert (counter.count(data, offsets) == got).all()


def test_null_and_shared_ids(spark, tmp_path):
    table = [(None, "mail a@b.cc now", "en", "s"), (5, "mail a@b.cc now", "en", "s"), (5, "no address", "en", "s"), (None, "plain", "en", "s"), (6, "x", "de", "s"), (6, "y z@z.zz", "de", "s")]
    docs = spark.createDataFrame([(*r, True, "v") for r in table], "doc_id long, text string, lang string, source string, marked boolean, tokenizer string").repartition(3)
    gone = spark.createDataFrame([(6,), (None,)], "doc_id long")
    assert got(C.maintain(docs, gone, str(tmp_path))) == brute(table, {6})


class Crash(Exception):
    pass


def test_a_crash_in_compaction_changes_no_total(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    ledger = C.count(docs).cache()
    store = C.Store(spark, str(tmp_path))
    n = 0

    def add():
        nonlocal n
        n += 1
        assert store.commit(f"batch/{n}", C.signed(ledger, 1))

    def crashing(name, when):
        real, calls = getattr(C.Store, name), []

        def run(self, *args):
            calls.append(args)
            if len(calls) == when:
                raise Crash
            return real(self, *args)

        return run

    add()
    add()
    one = got(store.totals())
    for name, when in (("_rows", 1), ("_renamed", 1), ("_settle", 1), ("_settle", 3), ("_taken", 2), ("_taken", 3)):
        add()
        before = got(store.totals())
        assert before == Counter({k: v // 2 * n for k, v in one.items()})
        with monkeypatch.context() as m:
            m.setattr(C.Store, name, crashing(name, when))
            with pytest.raises(Crash):
                store.compact()
                store.compact()
                add()
                store.compact()
                store.compact()
        assert got(C.Store(spark, str(tmp_path)).totals()) == Counter({k: v // 2 * n for k, v in one.items()})
        assert not store.commit("batch/1", C.signed(ledger, 1))
    while store.compact():
        pass
    assert got(store.totals()) == Counter({k: v // 2 * n for k, v in one.items()})
    add()
    store.compact()
    assert len(store._names("commits")) <= 2 and len(store._names("live")) == 2 and len(store._names("folded")) == 3  # one never counted: its maintainer died
    assert got(store.totals()) == Counter({k: v // 2 * n for k, v in one.items()})


def test_readers_beside_compactions(spark, tmp_path, monkeypatch):
    """Between every two steps of a reader another one commits and compacts, once or twice: the reader gets the totals of a moment."""
    delta = spark.createDataFrame([("s", "en", "v", 1, 5, 7)], C.SCHEMA).cache()
    other, n = C.Store(spark, str(tmp_path)), 0

    def add():
        nonlocal n
        n += 1
        assert other.commit(f"batch/{n}", delta)

    class Reader(C.Store):
        left, meddle = 0, None

    def stepping(name):
        real = getattr(C.Store, name)

        def step(self, *args):
            self.left -= 1
            if self.left == 0:
                self.meddle()
            return real(self, *args)

        return step

    for name in ("_pointer", "_generations", "_names", "_known", "_taken", "_rows"):
        setattr(Reader, name, stepping(name))
    reader = Reader(spark, str(tmp_path))

    def once():
        assert other.compact()

    def twice():
        other.compact()
        add()
        other.compact()
        add()
        other.compact()

    add()
    for meddle in (once, twice):
        reader.meddle, step, done = meddle, 0, False
        while not done:
            step += 1
            add()
            before, reader.left = n, step
            totals = reader.totals()
            done = reader.left > 0
            (row,) = totals.collect()
            assert before <= row.n_docs <= n and (row.n_tokens, row.n_bytes) == (5 * row.n_docs, 7 * row.n_docs), (meddle, step)
        assert step > 6
    assert [r.n_docs for r in other.totals().collect()] == [n]


def test_a_plan_outlives_one_compaction(spark, tmp_path):
    delta = spark.createDataFrame([("s", "en", "v", 1, 5, 7)], C.SCHEMA)
    store = C.Store(spark, str(tmp_path))
    for k in range(3):
        store.commit(f"b{k}", delta)
        planned = store.totals()
        assert store.compact()
        assert [tuple(r) for r in planned.collect()] == [("s", "en", "v", k + 1, 5 * (k + 1), 7 * (k + 1))]
    assert not any(store.commit(f"b{k}", delta) for k in range(3))


def test_a_late_copy_of_a_folded_batch(spark, tmp_path, monkeypatch):
    """A second delivery that looked before the first was committed, and is renamed after it was folded and deleted."""
    delta = spark.createDataFrame([("s", "en", "v", 1, 5, 7)], C.SCHEMA)
    store, real = C.Store(spark, str(tmp_path)), C.Store._renamed

    def late(self, source, target):
        monkeypatch.setattr(C.Store, "_renamed", real)
        for k in range(3):
            assert store.commit(("x", "y", "z")[k], delta)
            assert store.compact()
        return real(self, source, target)

    monkeypatch.setattr(C.Store, "_renamed", late)
    assert not store.commit("x", delta)
    assert [r.n_docs for r in store.totals().collect()] == [3]


def test_life_of_a_corpus(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").repartition(4)
    gone = spark.createDataFrame([(3,), (4,), (4,), (999,)], "doc_id long")
    assert got(C.maintain(docs, gone, str(tmp_path))) == brute(rows(), {3, 4})


def test_commits_are_idempotent_and_compact(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    ledger = C.count(docs).cache()
    store = C.Store(spark, str(tmp_path))
    assert store.commit("one", C.signed(ledger, 1)) and not store.commit("one", C.signed(ledger, 1))
    before = got(store.totals())
    store.compact()
    assert got(store.totals()) == before and not store.commit("one", C.signed(ledger, 1))
    assert store.commit("two", C.signed(ledger, -1)) and got(store.totals()) == Counter()
    assert store.totals().count() == 0


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert C.maintain(docs, docs, str(tmp_path)).count() == 0
