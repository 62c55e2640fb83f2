"""Benchmark decontamination by training suffix arrays.

Each step of training text becomes a shard with a word-level suffix array, sorted to the length of the longest
test item. The array is sparse: it holds the suffixes that start with one of the benchmark's k-grams,
k being the shortest test window or four words, as no other suffix can match. Every test suffix is then
binary-searched in every shard: the range that shares its window gives all occurrences, each is followed word by word to
its longest verbatim match, and the longest of a document is reported with its item and location. `longest_matches`
turns that round: the neighbours of a test suffix's place give its longest match anywhere, of k words or more. A
document lies whole in one shard, so nothing is shuffled but that report.

Defined cases: null or empty text has no words and is clean; an item without words is no query; items with equal
text are reported each; of equally long matches the one of the smallest item id, then the first in the document, is reported;
repeated rows and null ids are judged one by one; very long texts are one shard; other columns are ignored, whatever
their names. An empty benchmark leaves all clean. The benchmark is a stated query set: it goes to the workers in blocks of at
most BLOCK_BYTES, and each row passes through all of them in one scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .staging import small_batches

WINDOW = 10
BLOCK_BYTES = 16 << 20
KGRAM = 4


class Queries:
    """Test items: their words as dense ids (1 on; 0 ends a sequence), and their suffixes."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        text = pa.array([t for _, t in items], type=pa.large_string())
        data, offsets = T.text_bytes(text)
        w = T.Words(data, offsets)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self.spelling = [b""] + [w.text(i) for i in _first_of(ids, len(self.vocabulary))]
        size = np.diff(w.first)
        self.item = [i for i, _ in items]
        order = {i: k for k, i in enumerate(sorted({i for i in self.item if i is not None}), 1)}
        #: The place of each item's id in their order, null first.
        self.rank = np.array([order.get(i, 0) for i in self.item], dtype=np.int64)
        self.longest = int(size.max(initial=0))
        self.words = np.zeros(len(ids) + len(items) + self.longest + window, dtype=np.int64)
        place = np.arange(len(ids)) + w.row
        self.words[place] = ids + 1
        self.owner, self.start = w.row, place
        remains = w.first[w.row + 1] - np.arange(len(ids))
        #: A suffix starts a window if ten words remain, or if it is the whole of a shorter item.
        self.width = np.where(remains >= window, window, np.where(size[w.row] < window, np.where(np.arange(len(ids)) == w.first[w.row], remains, 0), 0))
        self.remains = remains
        short = self.width[self.width > 0].min(initial=window)
        self.k = int(min(KGRAM, short))
        self.grams = np.unique(_grams(self.words, place[remains >= self.k], self.k))


def _first_of(ids: np.ndarray, n: int) -> np.ndarray:
    at = np.full(n, -1, dtype=np.int64)
    at[ids[::-1]] = np.arange(len(ids))[::-1]
    return at


def _grams(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        h = T.splitmix64(h ^ words[at + i].astype(np.uint64))
    return h


class Shard:
    """The sparse suffix array of one step of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, q: Queries):
        self.words_of = w = T.Words(data, offsets)
        rows = len(offsets) - 1
        found = np.minimum(np.searchsorted(q.vocabulary, w.hash), max(len(q.vocabulary) - 1, 0))
        known = q.vocabulary[found] == w.hash if len(q.vocabulary) else np.zeros(len(w.hash), dtype=bool)
        self.place = np.arange(len(w.hash)) + w.row  # a zero between rows: no match crosses it
        self.words = np.zeros(len(w.hash) + rows + q.longest + WINDOW + 1, dtype=np.int64)
        self.words[self.place] = np.where(known, found + 1, 0)
        at = self.place[known]
        for i in range(1, q.k):
            at = at[self.words[at + i] > 0]
        if len(at):
            g = _grams(self.words, at, q.k)
            p = np.minimum(np.searchsorted(q.grams, g), len(q.grams) - 1)
            at = at[q.grams[p] == g]
        self.suffixes = self._sorted(at, q.longest)

    def _sorted(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Sort by the first `depth` words, word by word; only suffixes that still share a rank are looked at again.

        A suffix's rank is the number of suffixes below its group; a zero ends its sequence."""
        if not len(at):
            return at
        first = self.words[at]
        rank = np.searchsorted(np.sort(first), first)
        alive = np.ones(len(at), dtype=bool)
        for known in range(1, depth):
            open_ = (np.bincount(rank, minlength=len(at)) > 1) & (np.bincount(rank, weights=alive, minlength=len(at)) > 0)
            tied = np.flatnonzero(open_[rank])
            if not len(tied):
                break
            word = np.where(alive[tied], self.words[at[tied] + known], 0)
            alive[tied] = word > 0
            old = np.sort(rank[tied])
            key = rank[tied] * (int(self.words.max()) + 1) + word
            rank[tied] += np.searchsorted(np.sort(key), key) - np.searchsorted(old, rank[tied])
        return at[np.argsort(rank, kind="stable")]

    def compare(self, q: Queries, query: np.ndarray, suffix: np.ndarray, width: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the suffix against the query's first `width` words."""
        out, open_ = np.zeros(len(query), dtype=np.int8), width > 0
        for i in range(int(width.max(initial=0))):
            d = np.sign(self.words[suffix + i] - q.words[q.start[query] + i]).astype(np.int8)
            out = np.where(open_ & (out == 0) & (i < width), d, out)
        return out

    def search(self, q: Queries, query: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all queries at once: the first suffix not below (or the first above) each."""
        lo, hi = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(self.suffixes), dtype=np.int64)
        while (live := lo < hi).any():
            mid = (lo + hi) // 2
            c = np.zeros(len(query), dtype=np.int8)
            c[live] = self.compare(q, query[live], self.suffixes[mid[live]], width[live])
            low = live & ((c <= 0) if after else (c < 0))
            lo, hi = np.where(low, mid + 1, lo), np.where(live & ~low, mid, hi)
        return lo

    def occurrences(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(query suffix, first word) of every place where a window stands verbatim, word bytes compared."""
        query = np.flatnonzero(q.width > 0)
        if not len(self.suffixes) or not len(query):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        head = self.words[self.suffixes]
        present = np.isin(q.words[q.start[query]], head)
        query = query[present]
        width = q.width[query]
        lo, hi = self.search(q, query, width, False), self.search(q, query, width, True)
        own, at = T.ranges(lo, hi)
        word = np.searchsorted(self.place, self.suffixes[at])
        return self._verified(q, query[own], word, width[own])

    def followed(self, q: Queries, query: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How many words each occurrence goes on verbatim, to the end of the item at most, word bytes compared."""
        place, length, most = self.place[word], q.width[query].copy(), q.remains[query]
        live = np.flatnonzero(length < most)
        while len(live):
            live = live[self.words[place[live] + length[live]] == q.words[q.start[query[live]] + length[live]]]
            length[live] += 1
            live = live[length[live] < most[live]]
        more = length > q.width[query]
        _, at = T.ranges(word[more], word[more] + length[more])
        bad = np.array([i for i in np.unique(at) if self.words_of.text(i) != q.spelling[self.words[self.place[i]]]], dtype=np.int64)
        for k in np.flatnonzero(more) if len(bad) else ():
            length[k] = min([length[k], *(bad[(bad >= word[k]) & (bad < word[k] + length[k])] - word[k])])
        return length

    def _verified(self, q: Queries, query: np.ndarray, word: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids stand for 64-bit hashes; here the bytes of each matched word are held against the item's spelling."""
        _, at = T.ranges(word, word + width)
        bad = np.array([i for i in np.unique(at) if self.words_of.text(i) != q.spelling[self.words[self.place[i]]]], dtype=np.int64)
        if not len(bad):
            return query, word
        ok = np.array([not np.isin(np.arange(a, a + n), bad).any() for a, n in zip(word, width, strict=True)])
        return query[ok], word[ok]

    def longest(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix its longest verbatim match here, of at least k words: suffix, length, first word."""
        query = np.flatnonzero(q.remains >= q.k)
        if not len(self.suffixes) or not len(query):
            return (np.zeros(0, dtype=np.int64),) * 3
        place = self.search(q, query, q.remains[query], False)
        best, where = np.zeros(len(query), dtype=np.int64), np.zeros(len(query), dtype=np.int64)
        for side in (place - 1, place):
            ok = (side >= 0) & (side < len(self.suffixes))
            s = self.suffixes[np.clip(side, 0, len(self.suffixes) - 1)]
            n, alive = np.zeros(len(query), dtype=np.int64), ok.copy()
            for i in range(int(q.remains[query].max(initial=0))):
                alive &= (i < q.remains[query]) & (self.words[s + i] == q.words[q.start[query] + i])
                n += alive
                if not alive.any():
                    break
            where, best = np.where(n > best, s, where), np.maximum(n, best)
        ok = best >= q.k
        return query[ok], best[ok], np.searchsorted(self.place, where[ok])


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most `limit` bytes, streamed: one block at a time is on the driver."""
    block, size = [], 0
    for i, t in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        n = len((t or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    yield block


_built: dict[str, Queries] = {}


def queries_of(name: str, block: list[tuple], window: int) -> Queries:
    """A block's queries, built once by a worker."""
    if name not in _built:
        while len(_built) >= 2:
            _built.pop(next(iter(_built)))
        _built[name] = Queries(block, window)
    return _built[name]


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, n_words, hits (positions of hit words), items (ids that occur, distinct), and of its longest
    match the length in words (longest), the item (longest_item) and the first word's position (longest_at)."""
    item_type = benchmark.schema[item_id].dataType.simpleString()

    def one(rows: DataFrame, block: list[tuple], k: int, last: bool) -> DataFrame:
        name = uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = queries_of(name, block, window)
            for b in batches:
                data, offsets = T.text_bytes(b.column(1))
                for i, j in T.steps(offsets):
                    part = offsets[i : j + 1] - offsets[i]
                    s = Shard(data[offsets[i] : offsets[j]], part, q)
                    query, word = s.occurrences(q)
                    new = _rows(b.column(0).slice(i, j - i), s, q, query, word, item_type)
                    held = [(c, b.column(c).slice(i, j - i)) for c in kept]
                    added = [(f"{c}{k}", new.column(c)) for c in _FOUND]
                    yield pa.RecordBatch.from_arrays([x for _, x in held + added], [c for c, _ in held + added])

        kept = [c for c in rows.columns if not last or c != "text"]
        kinds = dict(zip(_FOUND, ("bigint", "array<bigint>", f"array<{item_type}>", "bigint", item_type, "bigint"), strict=True))
        types = dict(rows.dtypes)
        return rows.mapInArrow(T.tidy(work), ", ".join([f"{c} {types[c]}" for c in kept] + [f"{c}{k} {t}" for c, t in kinds.items()]))

    # a row goes through all blocks, so that repeated rows and null ids stay rows of their own; each block adds any subset of its hit words
    rows = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = list(blocks(benchmark, item_id, text))
    for k, block in enumerate(every):
        rows = one(rows, block, k, k == len(every) - 1)
    merged = lambda c: F.array_distinct(F.flatten(F.array(*(F.col(f"{c}{k}") for k in range(len(every))))))
    if len(every) == 1:
        merged = lambda c: F.col(f"{c}0")

    def longer(old: Column, new: Column) -> Column:
        a, b = ([x[c] for c in _FOUND[3:]] for x in (old, new))
        return F.when((b[0] > a[0]) | (b[0] == a[0]) & ((b[1] < a[1]) | (b[1] == a[1]) & (b[2] < a[2])), new).otherwise(old)

    found = [F.struct(*(F.col(f"{c}{k}").alias(c) for c in _FOUND[3:])) for k in range(len(every))]
    rows = rows.withColumn("best", F.aggregate(F.array(*found), found[0], longer))
    return rows.select("doc_id", F.col("n_words0").alias("n_words"), merged("hits").alias("hits"), merged("items").alias("items"), *(F.col(f"best.{c}").alias(c) for c in _FOUND[3:]))


#: What a scan finds in a document.
_FOUND = ("n_words", "hits", "items", "longest", "longest_item", "longest_at")


def _list_kind(item_type: str) -> pa.DataType | None:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}.get(item_type)


def _rows(ids: pa.Array, s: Shard, q: Queries, query: np.ndarray, word: np.ndarray, item_type: str) -> pa.RecordBatch:
    first, n = s.words_of.first, len(ids)
    _, hit = T.ranges(word, word + q.width[query])
    hit = np.unique(hit)
    row = s.words_of.row
    hits = pa.LargeListArray.from_arrays(np.searchsorted(row[hit], np.arange(n + 1)), pa.array(hit - first[row[hit]], type=pa.int64()))
    items: list[list] = [[] for _ in range(n)]
    for key in np.unique(row[word] * (len(q.item) + 1) + q.owner[query]):
        items[key // (len(q.item) + 1)].append(q.item[key % (len(q.item) + 1)])
    kind = _list_kind(item_type)
    # of each document the longest match, then the smallest item, then the first place
    length, doc, owner = s.followed(q, query, word), row[word], q.owner[query]
    order = np.lexsort((word, q.rank[owner], -length, doc))
    order = order[np.unique(doc[order], return_index=True)[1]]
    longest, at, item = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [None] * n
    longest[doc[order]], at[doc[order]] = length[order], word[order] - first[doc[order]]
    for d, o in zip(doc[order].tolist(), owner[order].tolist(), strict=True):
        item[d] = q.item[o]
    arrays = [ids, pa.array(np.diff(first), type=pa.int64()), hits.cast(pa.list_(pa.int64())), pa.array([_distinct(x) for x in items], type=pa.list_(kind) if kind else None), pa.array(longest), pa.array(item, type=kind), pa.array(at, mask=longest == 0)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", *_FOUND])


def _distinct(x: list) -> list:
    return list(dict.fromkeys(x))


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For every test suffix that occurs: item_id, item_pos, the longest verbatim match's length in words, and where it
    stands (doc_id, doc_pos; of equal ones the smallest). Shards report one row a suffix; a max combines them."""
    item_type = benchmark.schema[item_id].dataType.simpleString()
    id_type = docs.schema[doc_id].dataType.simpleString()

    def one(block: list[tuple]) -> DataFrame:
        name = uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = queries_of(name, block, WINDOW)
            for b in batches:
                data, offsets = T.text_bytes(b.column(1))
                ids = b.column(0)
                for i, j in T.steps(offsets):
                    s = Shard(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], q)
                    query, length, word = s.longest(q)
                    row = s.words_of.row[word]
                    begin = np.searchsorted(q.owner, q.owner[query])
                    yield pa.RecordBatch.from_arrays([pa.array([q.item[x] for x in q.owner[query]], type=_list_kind(item_type)), pa.array(query - begin, type=pa.int64()), pa.array(length, type=pa.int64()), ids.take(pa.array(row + i)), pa.array(word - s.words_of.first[row], type=pa.int64())], ["item_id", "item_pos", "length", "doc_id", "doc_pos"])

        return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(T.tidy(work), f"item_id {item_type}, item_pos bigint, length bigint, doc_id {id_type}, doc_pos bigint")

    every = None
    for b in blocks(benchmark, item_id, text):
        every = one(b) if every is None else every.unionByName(one(b))
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_pos")).alias("best")
    return every.groupBy("item_id", "item_pos").agg(best).select("item_id", "item_pos", (-F.col("best.l")).alias("length"), "best.doc_id", "best.doc_pos")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, all columns kept as they are. One scan, no shuffle."""
    columns, schema = docs.columns, docs.schema

    def one(kept: DataFrame, block: list[tuple]) -> DataFrame:
        place = columns.index(text)

        name = uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = queries_of(name, block, window)
            for b in batches:
                data, offsets = T.text_bytes(b.column(place))
                keep = np.ones(b.num_rows, dtype=bool)
                for i, j in T.steps(offsets):
                    s = Shard(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], q)
                    _, word = s.occurrences(q)
                    keep[i + s.words_of.row[word]] = False
                yield b.filter(pa.array(keep))

        return kept.mapInArrow(T.tidy(work), schema)

    docs = small_batches(docs)
    for b in blocks(benchmark, item_id, text):
        docs = one(docs, b)
    return docs


def digest(items: DataFrame) -> DataFrame:
    """The contract's columns: items as strings, sorted, joined by commas, hashed. Then the longest verbatim match; without one
    its length is 0, its item empty and its place -1."""
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return items.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest", F.coalesce(F.col("longest_item").cast("string"), F.lit("")).alias("longest_item"), F.coalesce("longest_at", F.lit(-1).cast("bigint")).alias("longest_at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bi AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
dg AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM di, ks WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
pair AS (SELECT DISTINCT doc_id, dg.i, b.item_id, dg.k, b.i AS j FROM dg JOIN (SELECT item_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi) b ON dg.k = b.k AND dg.g = b.g),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, k, i - j ORDER BY i) AS r FROM pair),
len AS (SELECT doc_id, item_id, k + count(*) - 1 AS n, min(i) - 1 AS spot FROM run GROUP BY doc_id, item_id, k, i - j, r),
top AS (SELECT * FROM len QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, spot) = 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(top.n, 0) AS BIGINT) AS longest, coalesce(CAST(top.item_id AS VARCHAR), '') AS longest_item, CAST(coalesce(top.spot, -1) AS BIGINT) AS longest_at
FROM dw LEFT JOIN top ON dw.doc_id = top.doc_id LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
