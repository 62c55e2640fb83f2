from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import views as V
from tallygrid.sources import datasets as D


def test_labelled_sets(spark):
    a = spark.createDataFrame([("q1", "b"), ("q2", "a")], "text string, label string")
    b = spark.createDataFrame([("q3", "c")], "text string, label string")
    train, test, classes = D.splits(a, b, "label")
    assert {r.name: r.class_id for r in classes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.class_id for r in test.collect()] == [2] and {r.text: r.class_id for r in train.collect()} == {"q1": 1, "q2": 0}
    rows = spark.createDataFrame([("x", "z", "train"), ("y", "a", "test")], "utt string, intent string, partition string")
    fact, dim = D.partition_of(rows, "train", "intent")
    assert [(r.query, r.class_id) for r in fact.collect()] == [("x", 1)] and dim.count() == 2
    bq = D.yes_no(spark.createDataFrame([("is it??", "  p\n", True)], "question string, passage string, answer boolean")).first()
    assert tuple(bq) == ("is it?", "p", 1)


def test_utterances(spark):
    rows = spark.createDataFrame([("d2", "n2", ["x"]), ("d1", "n1", ["a", "b"])], "id string, name string, utterances array<string>")
    assert sorted(tuple(r) for r in D.utterances(rows).collect()) == [(0, "n1", 0, "a"), (0, "n1", 1, "b"), (1, "n2", 0, "x")]
    pairs = spark.createDataFrame([("d", "q", ["a", "b"], [True, False])], "id string, question string, utterances array<string>, answers array<boolean>")
    assert [r.class_id for r in D.answered_utterances(pairs).orderBy("no").collect()] == [1, 0]
    with pytest.raises(Exception, match="differ in number"):
        D.answered_utterances(pairs.withColumn("answers", F.slice("answers", 1, 1))).collect()


def test_simple_eval(spark):
    rows = spark.createDataFrame([("a", "choice", ["z", "y", "x"], 1), ("b", "bool", ["no", "yes"], 0), ("c", "choice", list("abcdefg"), 0)], "id string, qtype string, options array<string>, answer int")
    got = {r.id: (r.set, r.label, r.option_ids) for r in D.simple_eval(rows).collect()}
    names = sorted(set("zyxabcdefg") | {"no", "yes"})
    assert got["a"] == ("k5", names.index("y"), [names.index(c) for c in "zyx"]) and got["b"][0] == "bool" and got["c"][0] == "k10"


def test_judged(spark):
    texts = spark.createDataFrame([("d", "t1", "x", {"q1": "yes"}), ("d", "t2", "long", {})], "domain string, text_id string, text string, stated map<string,string>")
    questions = spark.createDataFrame([("d", "q1", ["no", "yes", "unknown"]), ("d", "q2", ["no", "yes", "unknown"])], "domain string, question_id string, options array<string>")
    answers = spark.createDataFrame([("d", "t2", "q2", [1.0, 3.0, 0.0], "h")], "domain string, text_id string, question_id string, probs array<double>, hash string")
    applies = (F.col("question_id") == "q1") | (F.length("text") > 2)
    got = {(r.text_id, r.question_id): (r.source, r.gold_idx, r.target) for r in D.judged(texts, questions, answers, applies, F.lit("h")).collect()}
    assert got == {("t1", "q1"): ("stated", 1, None), ("t2", "q1"): ("unknown", 2, None), ("t2", "q2"): ("soft", 1, [0.25, 0.75, 0.0])}
    with pytest.raises(Exception, match="stale"):
        D.judged(texts, questions, answers, applies, F.lit("new")).collect()


def bound(spark):
    contexts = spark.createDataFrame([("tel", "c1", None, ["t"], [("q", {"view": 3.0, "cancel": 1.0}, "g")]), ("tel", "c2", "c1", ["u"], [("q", {"cancel": 1.0}, "g")])], "domain string, context_id string, contrast_of string, texts array<string>, questions array<struct<question:string,answer:map<string,double>,goal:string>>")
    bank = spark.createDataFrame([("tel", "q", "choice", ["ask"], [("view", "see it"), ("cancel", None)])], "domain string, question_id string, type string, asks array<string>, options array<struct<name:string,description:string>>")
    return contexts, bank


def test_bindings(spark):
    contexts, bank = bound(spark)
    extra = spark.createDataFrame([("tel", "c1", "q", ["cat"])], "domain string, context_id string, question_id string, categories array<string>")
    got = {r.context_id: r for r in D.bindings(contexts, bank, {"more": extra}).collect()}
    assert got["c1"].target == [0.75, 0.25] and got["c1"].gold == 0 and got["c1"].rows == ["view: see it", "cancel"] and got["c1"].more.categories == ["cat"]
    assert got["c2"].target is None and got["c2"].gold == 1 and got["c2"].contrast == "tel/c1/q" and got["c1"].contrast is None
    with pytest.raises(Exception, match="no option"):
        D.bindings(contexts, bank.withColumn("options", F.slice("options", 1, 1))).select("gold").collect()
    keys = spark.createDataFrame([("tel", "c2", "q")], "domain string, context_id string, question_id string")
    sums = spark.createDataFrame([("f", "1")], "path string, sha256 string")
    assert D.selected(D.bindings(contexts, bank), keys, sums, sums).count() == 1
    with pytest.raises(Exception, match="sources changed"):
        D.selected(D.bindings(contexts, bank), keys, sums, sums.withColumn("sha256", F.lit("2"))).collect()


def items(spark):
    schema = "key string, texts array<string>, langs array<string>, asks array<string>, rows array<string>, bare array<string>, fallback_row string, fallback_bare string, fallback_correct boolean, gold int, target array<double>, qtype string, i18n map<string,struct<asks:array<string>,rows:array<string>,bare:array<string>,fallback_row:string>>"
    de = {"de": (["frage"], ["eins", "zwei"], ["e", "z"], "sonst")}
    rows = [(f"k{i}", ["hello", "hallo"], ["en", "de"], ["ask"], ["one: 1", "two: 2"], ["one", "two"], "other: none", "other", i % 2 == 0, 1, [0.25, 0.75], "bool", de) for i in range(80)]
    return spark.createDataFrame(rows, schema)


def test_item_views(spark):
    rows = V.item_view(items(spark), "s", 0.5, 0.5).collect()
    assert len(rows) == 80
    for r in rows:
        german, added = r["query"] == "hallo", len(r.options) == 3
        assert r.question == ("frage" if german else "ask") and {r["query"], r.partner_query} == {"hello", "hallo"}
        assert r.qtype == ("choice" if added else "bool") and r.options[r.gold_idx] == r.label
        right = added and int(r.key[1:]) % 2 == 0
        assert r.label == (2 if right else 1) and (r.target is None) == right
        if r.target:
            assert sum(r.target) == pytest.approx(1) and r.target[r.gold_idx] == 0.75
        assert set(r.option_names) <= ({"eins", "zwei", "e", "z", "sonst", "other"} if german else {"one: 1", "two: 2", "one", "two", "other: none", "other"})
    assert 20 < sum(len(r.options) == 3 for r in rows) < 60
    assert all(len(r.options) == 2 for r in V.item_view(items(spark), "s", 0.0, 0.0).collect())
    assert all(len(r.options) == 3 for r in V.item_view(items(spark), "s", 1.0, 1.0).collect())


def menus(spark, n=20):
    return spark.createDataFrame([(k, list(range(12)), k % 12, [((k * 7 + j * 5) % 13) / 78 for j in range(12)], f"q{k}", f"p{k}" if k % 2 else None) for k in range(n)], "key int, options array<int>, gold_idx int, q array<double>, query string, partner_query string")


def test_variants(spark):
    rows = V.variants(menus(spark), "s", short=5).collect()
    assert len(rows) == 7 * 20
    for r in rows:
        assert r.options[r.gold_idx] == r.key % 12 and len(set(r.codes)) == len(r.codes) == len(r.options)
        assert len(r.options) == (5 if r.variant.startswith("short") else 12)
        if r.variant == "rows_only":
            assert r.codes == r.options
        if r.variant in ("repeat", "codes_only"):
            assert r.options == list(range(12))


def test_probe_passes_and_partners(spark):
    rows = V.probe_passes(menus(spark), 6, 3, "s").collect()
    assert len(rows) == 18 and len({r.key for r in rows}) == 6 and all(sorted(r.options) == list(range(12)) for r in rows)
    got = V.with_partners(menus(spark).withColumnRenamed("key", "row_no"), "s").orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(40))
    assert all(a.options != b.options and a.options[a.gold_idx] == b.options[b.gold_idx] for a, b in zip(got[::2], got[1::2], strict=True))
    assert got[3]["query"] == "p1" and got[1]["query"] == "q0"


def test_mixed_batch(spark):
    parts = {n: spark.range(50).select(F.concat(F.lit(n), F.col("id").cast("string")).alias("key")) for n in "ab"}
    one = V.mixed_batch(parts, 9, 1, "s", {"a": Fraction(2), "b": Fraction(1)}).collect()
    assert [sum(r.sampler == n for r in one) for n in "ab"] == [6, 3]
    assert one == V.mixed_batch(parts, 9, 1, "s", {"a": Fraction(2), "b": Fraction(1)}).collect() != V.mixed_batch(parts, 9, 2, "s", {"a": Fraction(2), "b": Fraction(1)}).collect()
    wide = spark.range(30).select("id", F.lit(b"x").alias("image"), F.lit("t").alias("texts"))
    assert D.sampled_extract(wide, "id", "texts", 4, "s").count() == 4
