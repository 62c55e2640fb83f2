import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P

sentencepiece = pytest.importorskip("sentencepiece")


def corpus():
    rnd = random.Random(8)
    syllables = {"en": ["the", "ing", "tion", "ow", "wh"], "fr": ["é", "que", "eau", "ou", "ç"], "de": ["sch", "ung", "ä", "ch", "pf"]}

    def prose(lang, n):
        return " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    items = [(k, prose("en", rnd.choice([4, 12, 30]))) for k in range(6)]
    texts = []
    for k in range(90):
        lang = rnd.choice(list(syllables))
        t = prose(lang, rnd.choice([1, 3, 30, 120, 300]))
        texts.append((lang, t))
        if k % 5 == 0:
            texts.append((lang, t.upper() if lang == "en" else t))
        if k % 7 == 0:
            w = t.split()
            w[len(w) // 2] = "edited"
            texts.append((lang, " ".join(w)))
        if k % 9 == 0:
            texts.append((None, t + " " + items[k % 6][1]))
    texts += [("en", None), ("en", ""), (None, "123 !!! 456"), ("de", " \n ")]
    return [(d, t, lang, f"src{d % 3}", len(t or "")) for d, (lang, t) in enumerate(texts)], items


def brute(docs, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(d, t) for d, t, *_ in docs if t and any(c.isalpha() for c in t)]
    last = {low(t): d for d, t in sorted(docs)}
    docs = [(d, t) for d, t in docs if last[low(t)] == d]
    sets = {}
    for d, t in docs:
        w = low(t).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {d: d for d, _ in docs}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= (label[a], label[b]) != (m, m)
            label[a] = label[b] = m
    docs = [(d, t) for d, t in docs if label[d] == d]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    keep = []
    for d, t in docs:
        w = words(t)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            keep.append((d, t))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.pieces.model_file())
    return {d: (sp.encode(t), t) for d, t in keep}


def test_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.ids, r.decoded) for r in P.run(spark, str(tmp_path)).collect()}
    assert got == brute(docs, items)
    assert 0 < len(got) < len(docs) - 30


def test_stages_keep_columns(spark, tmp_path):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, apply in P.STAGES[:-1]:
        assert apply(spark, table, str(tmp_path)).schema.names == table.schema.names


def run(spark, folder, docs, items, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return P.run(spark, str(folder)).collect()


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], [(1, "x")]) == []
    assert [r.doc_id for r in run(spark, tmp_path / "b", [(1, "some words here", "en", "s", 15)], [])] == [1]


def test_repeated_ids_ties_long_texts_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{'abcdefghij'[k % 10]}{k}" for k in range(60_000))
    item = " ".join(f"item{k}" for k in range(12))
    docs = [
        (1, "one two three four five six", "en"), (1, "one two three four five six", "en"),  # a repeated row
        (2, "seven eight nine ten", "en"), (2, "eleven twelve thirteen", "en"),  # one id, two texts
        (None, "red green blue white black", "en"), (3, "Red green blue white black", "en"), (None, None, None),
        (5, long, "en"), (6, long + " end", "en"), (7, f"{long} {item}", "en"), (8, f"before {item} behind", "en"),
    ]
    rows = [(d, t, lang, "s", 1, 2, 3, "x", 4) for d, t, lang in docs]
    got = run(spark, tmp_path, rows, [(1, item)], "doc_id long, text string, lang string, source string, set int, part int, keys int, digest string, _doc_id int")
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted([(1, docs[0][1]), (2, docs[2][1]), (2, docs[3][1]), (3, docs[5][1]), (5, long)])
