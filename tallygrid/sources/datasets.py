"""Named data sets as compositions of readers: labelled sets (fact and class dimension), utterance sets, bindings of questions to materials."""

from __future__ import annotations

import hashlib
import os
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import menus as M
from tallygrid.functions import text as X
from tallygrid.operators import corpus as C
from tallygrid.sources.adapters import must, size_bucket


def fetch(path: str, url: str, md5: str) -> Path:
    """A file by its checksum: kept if it is right, else downloaded beside and renamed once it is. Runs on the driver before any job."""
    target = Path(path)
    if target.exists() and _md5(target) == md5:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    urllib.request.urlretrieve(url, part)  # noqa: S310  the caller names the source
    if _md5(part) != md5:
        raise ValueError(f"{url}: md5 is {_md5(part)}, not {md5}")
    os.replace(part, target)
    return target


def _md5(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def labelled(rows: DataFrame, query: str, label: str, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A fact table (row columns, class_id) and its classes. `of`: all rows whose labels make the classes, where `rows` is one split of them."""
    classes = C.class_ids(rows if of is None else of, label)
    return C.with_class(rows, classes, label).withColumn("query", F.col(query)), classes


def splits(train: DataFrame, test: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two splits that share one class table, made of the labels of both."""
    both = train.select(label).unionByName(test.select(label))
    classes = C.class_ids(both, label)
    return C.with_class(train, classes, label), C.with_class(test, classes, label), classes


def partition_of(rows: DataFrame, partition: str, label: str) -> tuple[DataFrame, DataFrame]:
    """One partition; class ids come from all of them."""
    return labelled(rows.filter(F.col("partition") == partition), "utt", label, rows)


def yes_no(rows: DataFrame) -> DataFrame:
    """question, passage, answer -> a question mark exactly, the stripped passage as context, class 1 for yes."""
    return rows.select(X.normalise_question(F.col("question")).alias("question"), X.strip(F.col("passage")).alias("query"), F.col("answer").cast("int").alias("class_id"))


def utterances(rows: DataFrame) -> DataFrame:
    """id, name, utterances -> a row an utterance; a class is the rank of its id."""
    ids = C.class_ids(rows, "id").withColumnRenamed("name", "id")
    return rows.join(ids, "id").select("class_id", "name", F.posexplode("utterances").alias("no", "query"))


def answered_utterances(rows: DataFrame) -> DataFrame:
    """id, question, utterances, answers of the same length -> a row a pair."""
    zipped = must(F.size("utterances") == F.size("answers"), F.arrays_zip("utterances", "answers"), "utterances and answers differ in number")
    return rows.select("id", "question", F.posexplode(zipped).alias("no", "z")).select("id", "question", "no", F.col("z.utterances").alias("query"), F.col("z.answers").cast("int").alias("class_id"))


def simple_eval(rows: DataFrame) -> DataFrame:
    """id, qtype, options, answer -> option ids of one vocabulary over all rows, and the set by menu size. Names meet ids by a join on exploded options."""
    vocabulary = C.class_ids(rows.select(F.explode("options").alias("name")), "name")
    long = rows.select("id", F.posexplode("options").alias("pos", "name")).join(vocabulary, "name")
    ids = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "class_id"))), lambda s: s["class_id"]).alias("option_ids"))
    bucket = F.when(F.col("qtype") == "bool", "bool").otherwise(F.concat(F.lit("k"), size_bucket(F.size("options")).cast("string")))
    return rows.join(ids, "id").withColumns({"set": bucket, "label": F.get("option_ids", F.col("answer"))})


def judged(texts: DataFrame, questions: DataFrame, answers: DataFrame, applies: Column, item_hash: Column) -> DataFrame:
    """Texts with the questions that apply to them (a condition over both: a join on domain, filtered), left with their answers.

    A stated answer is hard; without one the option `unknown` is right; probabilities make a soft target. An answer whose hash isn't the item's is stale and fails the
    query. texts: domain, text_id, text, stated map<string,string>; questions: domain, question_id, options; answers: domain, text_id, question_id, probs, hash."""
    pairs = texts.join(questions, "domain").filter(applies)
    joined = pairs.withColumn("item_hash", item_hash).join(answers, ["domain", "text_id", "question_id"], "left")
    stated = F.col("stated")[F.col("question_id")]
    fresh = must(F.col("hash").isNull() | (F.col("hash") == F.col("item_hash")), F.col("probs"), "a stale answer")
    joined = joined.withColumn("probs", fresh)
    source = F.when(stated.isNotNull(), "stated").when(F.col("probs").isNotNull(), "soft").otherwise("unknown")
    hard = M.position_of(F.col("options"), F.coalesce(stated, F.lit("unknown")))
    gold = F.when(source == "soft", M.top(F.col("probs"))).otherwise(hard)
    return joined.withColumns({"source": source, "gold_idx": gold, "target": F.when(source == "soft", M.renormalize(F.col("probs")))})


def bindings(contexts: DataFrame, bank: DataFrame, overlays: dict[str, DataFrame] | None = None) -> DataFrame:
    """Materials (domain, context_id, contrast_of, texts, questions array<struct<question, answer map<string,double>, goal>>) with their questions of the bank (domain,
    question_id, type, asks, options array<struct<name, description>>): one row a binding, keyed domain/context/question.

    Answers are option names with weights: one name is hard, several are normalised into a target, gold the first maximum in menu order. Overlays (by domain, context_id,
    question_id) are joined on the left."""
    rows = contexts.select("domain", "context_id", "contrast_of", "texts", F.explode("questions").alias("q")).select("domain", "context_id", "contrast_of", "texts", F.col("q.question").alias("question_id"), F.col("q.answer").alias("answer"), F.col("q.goal").alias("goal"))
    known = rows.join(bank, ["domain", "question_id"], "left")
    options = must(F.col("options").isNotNull(), F.col("options"), "a question that the bank lacks")
    known = known.withColumn("options", options)
    names = F.transform("options", lambda o: o["name"])
    weights = F.transform(names, lambda n: F.coalesce(F.col("answer")[n], F.lit(0.0)))
    strange = F.size(F.array_except(F.map_keys("answer"), names)) > 0
    weights = must(~strange & (M.total(weights) > 0), weights, "an answer that is no option")
    out = known.withColumns({"rows": F.transform("options", lambda o: X.option_row(o["name"], o["description"])), "bare": names, "_w": weights})
    soft = F.size(F.filter("_w", lambda w: w > 0)) > 1
    out = out.withColumns({"gold": M.top(F.col("_w")), "target": F.when(soft, M.renormalize(F.col("_w"))), "key": F.concat_ws("/", "domain", "context_id", "question_id")}).drop("_w")
    for name, overlay in (overlays or {}).items():
        side = overlay.select("domain", "context_id", "question_id", F.struct(*[c for c in overlay.columns if c not in ("domain", "context_id", "question_id")]).alias(name))
        out = out.join(side, ["domain", "context_id", "question_id"], "left")
    return C.link_contrasts(out)


def selected(items: DataFrame, keys: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A selection of bindings, taken only from the sources that it was made of: any difference of checksums fails the query."""
    wrong = C.checksum_differences(expected, actual).agg(F.count(F.lit(1)).alias("_wrong"))
    ok = wrong.select(F.when(F.col("_wrong") == 0, True).otherwise(F.raise_error(F.lit("the sources changed"))).alias("_ok"))
    return C.select_keys(items, keys, ["domain", "context_id", "question_id"]).join(F.broadcast(ok)).filter("_ok").drop("_ok")


def sampled_extract(rows: DataFrame, key: str, narrow: str, n: int, seed: str) -> DataFrame:
    """n rows by hash order, chosen on the key and a narrow column alone; the wide columns are read only for what was chosen."""
    chosen = rows.filter(F.col(narrow).isNotNull()).select(key).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).limit(n)
    return rows.join(chosen, key, "left_semi")
