"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact.

Documents are sets of distinct word shingles. Two link when 100 * |A & B| >= 85 * |A | B|.

1. Every row gets a number of its own. Equal sets (128 bits and the size) are one class, which its first row stands for.
2. Candidates. A linked pair of sizes a, b differs in at most d = 15 (a + b) / 185 shingles. Sizes fall into overlapping classes such
   that every possible pair shares one; in a class, shingles are dealt by hash into m = d + slack segments, so a
   linked pair has at least m - d equal segments, and an equal segment is a key that both have. (Empty segments are keys
   only for a document that has `slack` of them or more; otherwise an equal one that isn't empty exists.) Which keys
   occur elsewhere is asked by packed exchange, and a document that shares fewer keys than a partner must have drops
   out before any row of it is made. What is left goes through a second round with finer segments.
3. Each key's documents hang on the one among them that shares most keys in all, its hub (a star, never all pairs), and
   of a document's keys a prefix is enough (see _stars). A hub and all that hangs on it are a unit; units of one
   family become one while it is small.
4. Within a unit, T-occurrence search over inverted lists finds each document's partners: DivideSkip counts the
   short lists, probes the long ones by binary search (or merges them too, where that is less work), and keeps what
   reaches the required overlap. The merge counts ids in one vectorised pass instead of popping a heap, with the same
   result. Documents that are already connected need no further link. A unit of more than CHUNK documents or UNIT_BYTES
   of sets is dealt into chunks, its hub in each. Documents that are then not connected with the hub get keys of their
   own: the unit's shingles, rarest first, of which a prefix is enough, make new units (see _by_tokens).
5. Components of the links give the classes.

Defined cases: null, empty or wordless text has no shingle, links with nothing and is its own component; a text with
fewer words than a shingle is one shingle; repeated rows are rows of one class each; a null doc_id is a row like others, and
a component's id is its smallest doc_id that is not null (null if there is none); ties go to the first row; other
columns are ignored, whatever their names; an empty table gives no rows. Words and shingles are 64-bit hashes without
a structure that texts could hit (see textkit), sets are compared by 128 bits and their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import staging
from . import textkit as T
from .components import components
from .staging import GROUP_BYTES, discard, release_shuffles, small, small_batches, stage

#: Production parameters of the contract: words of a shingle, and the threshold in percent.
SHINGLE, PERCENT = 4, 85
#: (ratio of neighbouring size classes, spare segments for each difference) of the two rounds of keys: few keys for all
#: documents, then finer ones for those that are left.
COARSE, FINE = (1.7, 0.1), (1.3, 0.3)
#: Most documents, and bytes of sets, that are searched at once; bytes of sets dealt to a group of units.
CHUNK, UNIT_BYTES, TASK_BYTES = 1024, 8 << 20, 4 << 20
#: Text bytes of a step (and of a block of keys): a step's arrays take some 60 bytes a byte.
STEP = 1 << 20
#: Hops from a hub to its family's weightiest.
ANCHOR_HOPS = 2
#: DivideSkip's weight of a probe against a step of the merge.
MU = 0.0085
#: A probe costs as much as so many steps of a merge.
PROBE = 16
_KINDS = T.splitmix64(np.arange(1000, 1016, dtype=np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a step's rows, sorted in each row; the n+1 offsets."""
    w = T.Words(data, offsets, spaces=True)
    count = np.diff(w.first)
    rows = len(count)
    n = len(w.hash)
    at = np.arange(n)
    full = at + width <= w.first[w.row + 1] if n else np.zeros(0, dtype=bool)
    at = at[full]
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(width):
        h += w.hash[at + i] * (_KINDS[i] | np.uint64(1))
    h = T.splitmix64(h)
    row = w.row[at]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(width - 1):
            there = count[short] > i
            extra += np.where(there, w.hash[np.minimum(w.first[short] + i, n - 1)] * (_KINDS[i] | np.uint64(1)), np.uint64(0))
        extra = T.splitmix64(extra ^ _KINDS[8 + count[short].clip(max=7)])
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def differences(a: int, b: int, percent: int) -> int:
    """Most shingles in which a linked pair of these sizes differs."""
    return (100 - percent) * (a + b) // (100 + percent)


class Sizes:
    """Size classes: (least, most, segments, slack); every pair that may link with a difference lies in one of them."""

    def __init__(self, percent: int, ratio: float = COARSE[0], spare: float = COARSE[1]):
        self.percent, self.ratio, self.spare = percent, ratio, spare
        self.least, self.most, self.segments, self.slack = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def grow(self, size: int) -> None:
        while not len(self.least) or self.least[-1] <= size:
            lo = 1 if not len(self.least) else max(int(self.least[-1]) + 1, math.ceil(self.least[-1] * self.ratio))
            top = max(lo, math.ceil(lo * self.ratio)) * 100 // self.percent + 1
            d = differences(top, top, self.percent)
            slack = 1 + math.ceil(self.spare * d)
            for name, x in (("least", lo), ("most", top), ("segments", d + slack), ("slack", slack)):
                setattr(self, name, np.append(getattr(self, name), x))

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, class) for all classes of each row that may have a partner other than its equals."""
        self.grow(int(size.max(initial=1)))
        may = differences(1, 1, self.percent) + np.array([differences(int(s), int(s) + 1, self.percent) for s in np.unique(size)]) > 0
        able = may[np.searchsorted(np.unique(size), size)] if len(size) else np.zeros(0, dtype=bool)
        row, kind = [], []
        for c in range(len(self.least)):
            r = np.flatnonzero(able & (size >= self.least[c]) & (size <= self.most[c]))
            row.append(r)
            kind.append(np.full(len(r), c))
        return np.concatenate([np.zeros(0, dtype=np.int64), *row]), np.concatenate([np.zeros(0, dtype=np.int64), *kind])


def keys(h: np.ndarray, offsets: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, ...]:
    """The segment keys of a step's sets, group by group; each group's number of keys, its row and need. A group is a row in one size class; two
    linked sets of a class have at least `need` of its keys in common, for either one's need: of the equal segments those are
    no common key that are empty and that one of the two emits no empty key for, which has fewer than `slack` of them."""
    size = np.diff(offsets)
    row, kind = sizes.of(size)
    none = np.zeros(0, dtype=np.int64)
    if not len(row):
        return none.astype(np.uint64), none, none, none
    m = sizes.segments[kind]
    base = np.concatenate([[0], np.cumsum(m)])
    owner, at = T.ranges(offsets[row], offsets[row + 1])
    value = h[at]
    cell = base[owner] + (T.splitmix64(value ^ _KINDS[5]) % m[owner].astype(np.uint64)).astype(np.int64)
    mixed = T.splitmix64(value ^ _KINDS[6])
    count = np.bincount(cell, minlength=base[-1])
    # sums modulo 2**64 of each segment's values, in two exact halves
    low = np.bincount(cell, weights=(mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=base[-1]).astype(np.uint64)
    high = np.bincount(cell, weights=(mixed >> np.uint64(32)).astype(np.float64), minlength=base[-1]).astype(np.uint64)
    which = np.repeat(np.arange(len(row)), m)
    segment = np.arange(base[-1]) - base[which]
    empty = np.bincount(which[count == 0], minlength=len(row))
    all_of_it = empty >= sizes.slack[kind]
    use = (count > 0) | all_of_it[which]
    tag = T.splitmix64(((kind[which] << 40) + segment).astype(np.uint64) ^ _KINDS[7])
    key = T.splitmix64(low + (high << np.uint64(32)) + count.astype(np.uint64) * _KINDS[4] ^ tag)
    a = size[row]
    largest = np.minimum(a * 100 // sizes.percent, sizes.most[kind])
    need = m - (100 - sizes.percent) * (a + largest) // (100 + sizes.percent) - np.where(all_of_it, sizes.slack[kind] - 1, empty)
    return key[use], np.bincount(which[use], minlength=len(row)), row, need


def prints(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set."""
    out = []
    for k in (2, 3):
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(T.splitmix64(h ^ _KINDS[k]), out=total[1:])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return out[0], out[1]


#: Packed columns of a block. The first three are empty in the second round.
_COLUMNS = {"doc_ids": np.int64, "absent": np.bool_, "text_keys": np.int64, "ids": np.int64, "sizes": np.int64, "print1": np.uint64, "print2": np.uint64, "keys": np.uint64, "group_sizes": np.int32, "group_rows": np.int32, "group_needs": np.int32}
_BLOCK = "block_id bigint, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _packed(block_id: int, arrays: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block_id], pa.int64()), *(pa.array([np.ascontiguousarray(x, dtype=t).tobytes()], pa.binary()) for x, t in zip(arrays, _COLUMNS.values(), strict=True))], ["block_id", *_COLUMNS])


def _blocks(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Steps of rows (doc_id, text_key, text): numbers of the rows, sizes and prints of their sets, their keys and groups. Written,
    so that a row's number is the same for whoever reads it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent, *COARSE)
        block, row = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        for b in batches:
            data, offsets = T.text_bytes(b.column(2))
            absent = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids, text_keys = pc.fill_null(b.column(0), 0).to_numpy(), b.column(1).to_numpy()
            for i, j in T.steps(offsets, STEP):
                h, o = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield _packed(block, (doc_ids[i:j], absent[i:j], text_keys[i:j], np.arange(row, row + j - i), np.diff(o), *prints(h, o), *keys(h, o, sizes)))
                block, row = block + 1, row + j - i

    return stage(small_batches(docs).mapInArrow(T.tidy(work), _BLOCK), "none", group_bytes=GROUP_BYTES)


def _finer_blocks(picked: DataFrame, percent: int, width: int) -> DataFrame:
    """The same for chosen rows (id, n, p1, p2, text), with finer keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent, *FINE)
        block = TaskContext.get().partitionId() << 32
        none = np.zeros(0)
        for table, h, o in _sets(batches, width):
            yield _packed(block, (none, none, none, table.column("id").to_numpy(), np.diff(o), *prints(h, o), *keys(h, o, sizes)))
            block += 1

    return stage(picked.mapInArrow(T.tidy(work), _BLOCK), "none", group_bytes=GROUP_BYTES)


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], dtype=t) for c, t in _COLUMNS.items())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block."""
    for row in X.each_block(batches):
        doc_ids, absent, text_keys, ids, sizes, p1, p2 = (np.frombuffer(row[c], dtype=t) for c, t in list(_COLUMNS.items())[:7])
        # a wordless row is a class of its own
        p1 = np.where(sizes == 0, ids, p1.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block_id"])), pa.array(ids), pa.array(doc_ids, mask=absent), pa.array(text_keys), pa.array(sizes), pa.array(p1), pa.array(p2.view(np.int64))], ["block_id", "id", "doc_id", "text_key", "n", "p1", "p2"])


def _enough(group: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the keys left belong to groups that still have as many as they need."""
    return (np.bincount(group, minlength=len(need)) >= need)[group]


def _postings(blocks: DataFrame, bits: int, copies: DataFrame | None = None) -> DataFrame:
    """(key, id, grp, need) of the keys that rows share, after two exchanges: the second leaves out keys that only dropped rows
    share. A group with fewer shared keys than it needs has no partner and drops out. `copies` (block_id, copies): rows
    that others stand for."""

    def own(row: dict) -> tuple[np.ndarray, ...]:
        *_, ids, _, _, _, key, size, group_row, need = _arrays(row)
        group = np.repeat(np.arange(len(size), dtype=np.int32), size)
        if row.get("copies"):
            use = ~np.isin(ids, np.array(row["copies"], dtype=np.int64))[group_row[group]]
            key, group = key[use], group[use]
        return ids[group_row], need, key, group

    def shared(row: dict) -> tuple[np.ndarray, ...]:
        ids, need, key, group = own(row)
        distinct, _ = X.condensed(key, None)
        use = X.flags(distinct, row["r1"], bits)[0][np.searchsorted(distinct, key)]
        key, group = key[use], group[use]
        use = _enough(group, need)
        return ids, need, key[use], group[use]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            yield X.request(row["block_id"], own(row)[2], None, bits)

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            yield X.request(row["block_id"], shared(row)[2], None, bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.each_block(batches):
            ids, need, key, group = shared(row)
            distinct, _ = X.condensed(key, None)
            use = X.flags(distinct, row["r2"], bits)[0][np.searchsorted(distinct, key)]
            key, group = key[use], group[use]
            use = _enough(group, need)
            yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(ids[group[use]]), pa.array(group[use]), pa.array(need[group[use]])], ["key", "id", "grp", "need"])

    if copies is not None:
        blocks = blocks.join(copies, "block_id", "left")
    one = X.attach(blocks, X.answers(blocks.mapInArrow(T.tidy(ask), X.REQUEST)), "r1")
    release_shuffles(blocks.sparkSession)
    two = X.attach(one, X.answers(one.mapInArrow(T.tidy(ask_again), X.REQUEST)), "r2")
    return stage(two.mapInArrow(T.tidy(rows), "key bigint, id bigint, grp int, need int"))


def _stars(postings: DataFrame) -> DataFrame:
    """(id, hub, weight): documents hang on the hubs of their keys; a key's hub is the document among its own that shares most keys in all.

    A prefix of its keys is enough for each document: partners share `need` keys, so with `need` - 1 keys fewer, in one
    order for all, they still share one. The order puts the keys of the weightiest hubs first, which leaves few hubs a
    document. Counts are partial sums before any shuffle; a key of very many documents is a skewed join that Spark splits."""
    count = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = postings.join(count, "key").groupBy("id").agg(F.sum(F.col("n") - 1).alias("weight"))
    weighed = stage(postings.join(weight, "id"))
    hub = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("neg"))).alias("h")).select("key", (-F.col("h.neg")).alias("hub"), F.col("h.weight").alias("hub_weight"))
    own = Window.partitionBy("id", "grp")  # a document's own keys, fewer than its shingles
    ranked = weighed.join(hub, "key").withColumn("rank", F.row_number().over(own.orderBy(F.desc("hub_weight"), "hub", "key"))).withColumn("keys", F.count(F.lit(1)).over(own))
    first = ranked.filter(F.col("rank") <= F.col("keys") - F.col("need") + 1)
    rows = stage(first.select("id", "hub", "weight", "hub_weight").distinct(), light=True)
    # hubs of one family hang on its weightiest; their units become one as long as it stays within a chunk, so that a
    # document's set is sent once and not once a hub. Any unit does, if all of a key's documents go to the same.
    best = rows.groupBy("id").agg(F.max(F.struct("hub_weight", (-F.col("hub")).alias("neg"))).alias("b")).select(F.col("id").alias("_d"), (-F.col("b.neg")).alias("_b"), F.col("b.hub_weight").alias("_w"))
    anchors = rows.select("hub", F.col("hub").alias("anchor"), F.col("hub_weight").alias("anchor_weight")).distinct()
    for _ in range(ANCHOR_HOPS):
        anchors = anchors.join(best, F.col("anchor") == F.col("_d"), "left").select("hub", F.coalesce("_b", "anchor").alias("anchor"), F.coalesce("_w", "anchor_weight").alias("anchor_weight"))
    moved = rows.join(stage(anchors, light=True), "hub")
    fits = moved.select("anchor", "id").distinct().groupBy("anchor").agg((F.count(F.lit(1)) < CHUNK).alias("fits"))
    moved = moved.join(fits, "anchor").select("id", "weight", F.when(F.col("fits"), F.col("anchor")).otherwise(F.col("hub")).alias("hub"), F.when(F.col("fits"), F.col("anchor_weight")).otherwise(F.col("hub_weight")).alias("hub_weight"))
    moved = stage(moved.distinct(), light=True)
    hubs = moved.select(F.col("hub").alias("id"), "hub", F.col("hub_weight").alias("weight"))
    return stage(moved.select("id", "hub", "weight").unionByName(hubs).distinct(), light=True)


class Lists:
    """Inverted lists of a group of sets: shingle -> positions of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets], dtype=np.int64)
        every, owner = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.values, self.owner = every[order], owner[order]
        self.shingle = np.unique(self.values)
        self.begin = np.searchsorted(self.values, self.shingle)
        self.end = np.append(self.begin[1:], len(self.values))
        #: List and set of each entry in one ascending number.
        self.entry = np.repeat(np.arange(len(self.shingle)), self.end - self.begin) * len(sets) + self.owner

    def _merged(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists each set stands in."""
        _, place = T.ranges(self.begin[lists], self.end[lists])
        return np.bincount(self.owner[place], minlength=len(self.size))

    def _probed(self, lists: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The same for the sets `some`, by binary search of each list."""
        many = len(self.size)
        key = (lists[:, None] * many + some[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        return (self.entry[at] == key).reshape(len(lists), len(some)).sum(axis=0)

    def search(self, query: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Positions among `wanted` (a mask) that link with the query's set."""
        a = len(query)
        least = -(-percent * a // 100)  # a partner has at least that many shingles, and shares so many
        need = max(1, -(-percent * (a + least) // (100 + percent)))
        at = np.searchsorted(self.shingle, query)
        at = at[(at < len(self.shingle)) & (self.shingle[np.minimum(at, max(len(self.shingle) - 1, 0))] == query)] if len(self.shingle) else at[:0]
        if len(at) < need:
            return np.zeros(0, dtype=np.int64)
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        length = np.sort(length)
        aside = min(int(need / (MU * math.log2(max(2, int(length[-1]))) + 1)), need - 1)
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        # the merge: ids of the short lists and how often each stands there
        count = self._merged(short)
        some = np.flatnonzero(wanted & (count >= need - aside) & (self.size >= least) & (self.size * percent <= 100 * a))
        if not len(some):
            return some
        if len(some) * len(long) * PROBE < (self.end[long] - self.begin[long]).sum():
            count = count[some] + self._probed(long, some)
        else:  # so many candidates that the long lists are merged faster than probed
            count = (count + self._merged(long))[some]
        union = a + self.size[some] - count
        return some[100 * count >= percent * union]


def _links(sets: list[np.ndarray], order: np.ndarray, percent: int, queries: np.ndarray | None = None, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what links connect. `queries`: positions to search for (all); `apart`: known classes."""
    lists = Lists(sets)
    label = np.arange(len(sets)) if apart is None else np.unique(apart, return_inverse=True)[1]
    out = []
    for q in order if queries is None else queries:
        wanted = label != label[q]
        if not wanted.any():
            continue
        for p in lists.search(sets[q], wanted, percent):
            if label[p] != label[q]:
                out.append((int(q), int(p)))
                label[label == label[p]] = label[q]
    return out


def _connected(n: int, found: list[tuple[int, int]], start: int) -> np.ndarray:
    """Which of n sets the links found connect with one of them."""
    label = np.arange(n)
    for a, b in found:
        label[label == label[b]] = label[a]
    return label == label[start]


def _pairs(ids: np.ndarray, found: list[tuple[int, int]], link: bool) -> pa.RecordBatch:
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[ends[:, 0]], pa.int64()), pa.array(ids[ends[:, 1]], pa.int64()), pa.array(np.full(len(ends), link))], ["a", "b", "link"])


def _table_sets(table: pa.Table) -> list[np.ndarray]:
    data, offsets = T.text_bytes(table.column("set"))
    values = (data if data.ctypes.data % 8 == 0 else data.copy()).view(np.uint64)
    return [values[a:z] for a, z in zip(offsets[:-1] // 8, offsets[1:] // 8, strict=True)]


def _located(docs: DataFrame, chosen: DataFrame, row_bytes: int) -> DataFrame:
    """`chosen` (doc_id, text_key and other columns) with the texts, which are read again and stay where they are read as
    long as `chosen` is small enough to go to all executors. Texts that only share a text_key are told apart by _sets."""
    other = [c for c in chosen.columns if c not in ("doc_id", "text_key")]
    side = small(chosen.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"}), row_bytes)
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_doc_id"]) & (docs["text_key"] == side["_text_key"])).select(*other, "text")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Steps of located rows with their sets' shingles and offsets; a text that is not the chosen one drops out, and so does
    what the task has met already (repeated rows)."""
    met: set[int] = set()
    for b in batches:
        data, offsets = T.text_bytes(b.column(b.schema.get_field_index("text")))
        p1, p2, n, ids = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("p1", "p2", "n", "id"))
        for i, j in T.steps(offsets, STEP):
            h, o = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            one, two = prints(h, o)
            ok = (one.view(np.int64) == p1[i:j]) & (two.view(np.int64) == p2[i:j]) & (np.diff(o) == n[i:j])
            for k in np.flatnonzero(ok):
                ok[k] = int(ids[i + k]) not in met
                met.add(int(ids[i + k]))
            if not ok.all():
                _, at = T.ranges(o[:-1][ok], o[1:][ok])
                h, o = h[at], np.concatenate([[0], np.cumsum(np.diff(o)[ok])])
            yield b.slice(i, j - i).filter(pa.array(ok)), h, o


def _with_sets(docs: DataFrame, chosen: DataFrame, width: int, row_bytes: int) -> DataFrame:
    """`chosen` (id, doc_id, text_key, n, p1, p2 and other columns) with the sets of its documents; located columns go."""
    picked = _located(docs, chosen, row_bytes)
    names = [c for c in picked.columns if c not in ("p1", "p2", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, o in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array([h[a:z].tobytes() for a, z in zip(o[:-1], o[1:], strict=True)], pa.binary())], [*names, "set"])

    return picked.mapInArrow(T.tidy(work), ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in names) + ", set binary")


def _dealt(documents: Column, size: Column, most: int) -> Column:
    """Into how many parts of CHUNK documents and UNIT_BYTES."""
    return F.greatest(F.ceil(documents / most), F.ceil(size / UNIT_BYTES), F.lit(1)).cast("int")


def _search(docs: DataFrame, reps: DataFrame, stars: DataFrame, percent: int, width: int, again: bool = True) -> DataFrame:
    """Links of all units. stars: (id, hub, weight), the hub's own row included; a hub and all that hangs on it are a unit.
    reps: (id, doc_id, text_key, n, p1, p2). `again`: what large units leave open goes into units of its own first."""

    def within(table: pa.Table) -> pa.Table:
        """Links of a group's parts; of large units also the rows (hub, document) of what isn't connected with the hub here."""
        out = []
        part, sets, every = table.column("part").to_numpy(), _table_sets(table), table.column("id").to_numpy()
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            at = at[np.unique(every[at], return_index=True)[1]]  # a row that was read twice
            ids, weight, hub, chunks = (table.column(c).to_numpy()[at] for c in ("id", "weight", "hub", "chunks"))
            found = _links([sets[k] for k in at], np.lexsort((ids, -weight)), percent)
            out.append(_pairs(ids, found, True))
            if chunks[0] > 1:
                middle = int(np.flatnonzero(ids == hub)[0])
                apart = np.flatnonzero(~_connected(len(ids), found, middle))
                out.append(_pairs(ids, [(middle, int(k)) for k in apart], False))
        return pa.Table.from_batches(out)

    sized = stage(stars.join(small(reps.select("id", "n"), 24), "id"), light=True)
    held = F.col("n") * 8 + 64
    unit = sized.groupBy("hub").agg(F.count(F.lit(1)).alias("documents"), F.sum(held).alias("bytes")).filter("documents > 1")
    unit = stage(unit.select("hub", "bytes", _dealt(F.col("documents"), F.col("bytes"), CHUNK).alias("chunks")), light=True)
    placed = sized.join(small(unit.select("hub", "chunks"), 24), "hub").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # the hub of a large unit stands in each of its chunks
    chunk = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    tasks = (unit.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES + 1
    # a document is read once and then sent to all its parts
    parts = placed.withColumn("chunk", F.explode(chunk)).groupBy("id").agg(F.max("weight").alias("weight"), F.collect_list(F.struct(F.xxhash64("hub", "chunk").alias("part"), "hub", "chunks")).alias("parts"))
    parts = stage(reps.join(parts, "id"), light=True)
    sets = _with_sets(docs, parts, width, 160).select("id", "weight", "set", F.explode("parts").alias("p")).select("id", "weight", "set", "p.part", "p.hub", "p.chunks")
    found = stage(sets.withColumn("task", F.pmod("part", F.lit(tasks))).groupBy("task").applyInArrow(within, "a bigint, b bigint, link boolean"))
    links = found.filter("link").select("a", "b")
    if not unit.filter(F.col("chunks") > 1).head(1):
        return links

    # large units: what isn't connected with the hub
    apart = stage(found.filter(~F.col("link")).select(F.col("a").alias("hub"), F.col("b").alias("id"), F.lit(True).alias("asks")).distinct(), light=True)
    if not apart.head(1):
        return links
    pieces = apart.join(small(reps.select("id", "n"), 24), "id").groupBy("hub").agg(_dealt(F.count(F.lit(1)), F.sum(held), CHUNK).alias("pieces"))
    # units in which nothing is apart drop out here
    large = placed.join(pieces, "hub").join(apart, ["hub", "id"], "left").select("id", F.struct("hub", "chunks", "own", "pieces", F.coalesce("asks", F.lit(False)).alias("asks")).alias("u"))
    large = stage(reps.join(large.groupBy("id").agg(F.collect_list("u").alias("units")), "id"), light=True)
    large = _with_sets(docs, large, width, 160).select("id", "n", "set", F.explode("units").alias("u")).select("id", "n", "set", "u.*")
    if again:
        return links.unionByName(_search(docs, reps, _stars(_by_tokens(large, percent)), percent, width, False))

    # units that even the rarest shingles leave large: a piece of what is apart against each chunk
    asked = large.filter("asks").select("hub", F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "set", "asks", F.lit(True).alias("apart"))
    against = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("own").alias("chunk"), "id", "set", F.lit(False).alias("asks"), F.col("asks").alias("apart"))

    def across(table: pa.Table) -> pa.Table:
        ids, asks, alone = table.column("id").to_numpy(), *(table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "apart"))
        queries = np.flatnonzero(asks)
        # what is connected with the hub is one class
        return pa.Table.from_batches([_pairs(ids, _links(_table_sets(table), queries, percent, queries, np.where(alone, ids, np.iinfo(np.int64).min)), True)])

    more = asked.unionByName(against).groupBy("hub", "piece", "chunk").applyInArrow(across, "a bigint, b bigint, link boolean")
    return links.unionByName(stage(more).select("a", "b"))


def _by_tokens(large: DataFrame, percent: int) -> DataFrame:
    """Postings of the large units' documents (hub, id, n, set, asks) by their rarest shingles.

    Partners share ceil(percent * size / 100) shingles of the larger set at least, so in one order for the whole unit the
    first size - ceil(...) + 1 of each hold a common one; the order puts first what is rarest in the unit. Shingles that
    no document apart has, or only one document, are no keys. All counts are partial sums, and no set is sent but as
    its shingles, once. A row that is read twice, by different tasks, counts twice in that order and once in its prefix: any order of the
    unit does, but a shingle has to have one rank."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_bytes(b.column(4))
            token = (data if data.ctypes.data % 8 == 0 else data.copy()).view(np.int64)
            owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(offsets) // 8))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(owner) for k in range(4)), pa.array(token)], ["hub", "id", "n", "asks", "token"])

    tokens = stage(large.select("hub", "id", "n", "asks", "set").mapInArrow(T.tidy(work), "hub bigint, id bigint, n bigint, asks boolean, token bigint"))
    count = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("documents"), F.max("asks").alias("asked"))
    rank = F.dense_rank().over(Window.partitionBy("hub", "id").orderBy("documents", "token"))  # one document's shingles
    first = tokens.join(count, ["hub", "token"]).withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return stage(first.filter("documents > 1 and asked").select(F.xxhash64("hub", "token").alias("key"), "id", F.lit(0).alias("grp"), F.lit(1).alias("need")).distinct())


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """One row a row of docs: id (its number), doc_id, text_key, n, cls (the number that stands for equal sets), least_id (the
    class's smallest doc_id), component (the smallest number that links reach). Written."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    blocks = _blocks(docs, percent, width)
    total = blocks.select(F.sum(F.octet_length("keys"))).first()[0] or 0
    rows = stage(blocks.select("block_id", *list(_COLUMNS)[:7]).mapInArrow(_members, "block_id bigint, id bigint, doc_id bigint, text_key bigint, n bigint, p1 bigint, p2 bigint"))
    same = rows.groupBy("n", "p1", "p2").agg(F.min("id").alias("cls"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("members"))
    several = stage(same.filter("members > 1").drop("members"), light=True)
    named = rows.join(small(several, 48), ["n", "p1", "p2"], "left")
    named = stage(named.select("block_id", "id", "doc_id", "text_key", "n", "p1", "p2", F.coalesce("cls", "id").alias("cls"), F.coalesce("least_id", "doc_id").alias("least_id")))
    discard(rows)
    copies = named.filter("id <> cls")
    by_block = copies.groupBy("block_id").agg(F.collect_list("id").alias("copies"))  # at most a step's rows in each
    by_block = stage(by_block, light=True)
    postings = _postings(blocks, X.bucket_bits(total // 8), F.broadcast(by_block) if copies.count() * 16 <= staging.BROADCAST_BYTES else by_block)
    discard(blocks)  # all that is needed of it is written by now
    release_shuffles(spark)

    # what is left, a small part of near copies, gets finer keys
    left = stage(postings.select("id").distinct(), light=True)
    discard(postings)
    reps = stage(named.join(small(left, 16), "id", "left_semi").select("id", "doc_id", "text_key", "n", "p1", "p2"), light=True)
    finer = _finer_blocks(_located(docs, reps, 64), percent, width)
    total = finer.select(F.sum(F.octet_length("keys"))).first()[0] or 0
    postings = _postings(finer, X.bucket_bits(total // 8))
    discard(finer)
    release_shuffles(spark)
    links = _search(docs, reps, _stars(postings), percent, width)
    release_shuffles(spark)
    label = stage(components(links, "a", "b"), light=True)
    label = small(label.withColumnsRenamed({"node": "cls", "label": "component"}), 32)
    out = named.join(label, "cls", "left").select("id", "doc_id", "text_key", "n", "cls", "least_id", F.coalesce("component", "cls").alias("component"))
    return stage(out)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (of equal sets: the smallest doc_id), component_id."""
    rows = labelled(docs, doc_id, text, percent, width)
    linked = rows.filter("component <> cls").select("component").distinct()
    linked = stage(rows.join(small(stage(linked, light=True), 16), "component", "left_semi").groupBy("component").agg(F.min("least_id").alias("component_id"), F.lit(True).alias("linked")), light=True)
    at = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id"))
    return rows.join(small(linked, 32), "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("least_id").alias("class_id"), at.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest doc_id (null last), all columns as they are. Of repeated rows of one doc_id
    and text the first in the order of their other columns stays."""
    rows = labelled(docs, doc_id, text, percent, width).filter("n > 0")
    several = stage(rows.groupBy("component").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("component"), light=True)
    rows = stage(rows.join(small(several, 16), "component", "left_semi").select("component", "doc_id", "text_key"), light=True)
    # the first of a component by (null last, doc_id, text_key) as two partial minimums, so that a large one is a row a task
    least = rows.groupBy("component").agg(F.min("doc_id").alias("stays"))
    rows = rows.join(least, "component")
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("stays"))).groupBy("component", F.col("doc_id").alias("stays")).agg(F.min("text_key").alias("text"))
    twice = rows.filter(F.col("doc_id").eqNullSafe(F.col("stays"))).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(first.select("component", "text"), "component").join(twice.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("text_key") == F.col("text"))
    marks = stage(rows.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), (stays & (F.col("times") > 1)).alias("_repeated"), stays.alias("_stays")).distinct().filter("_repeated or not _stays"), light=True)
    side = small(marks.select("_doc_id", "_text_key"), 32)
    key, text_key = docs[doc_id].cast("bigint"), F.xxhash64(docs[text])
    kept = docs.join(side, key.eqNullSafe(side["_doc_id"]) & (text_key == side["_text_key"]), "left_anti")
    again = marks.filter("_repeated").select("_doc_id", "_text_key")
    if not again.head(1):
        return kept
    again = small(again, 32)
    repeated = docs.join(again, key.eqNullSafe(again["_doc_id"]) & (text_key == again["_text_key"]), "left_semi")
    order = Window.partitionBy(F.col(doc_id), F.xxhash64(F.col(text))).orderBy(F.to_json(F.struct("*")))
    number = "_row_number"
    while number in docs.columns:
        number += "_"
    return kept.unionByName(repeated.withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).drop(number))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
s2 AS (SELECT sh.doc_id, sh.g FROM sh JOIN df ON sh.g = df.g),
able AS (SELECT s2.doc_id FROM s2 JOIN n ON s2.doc_id = n.doc_id GROUP BY s2.doc_id, n.n HAVING 100 * count(*) >= 85 * n.n),
s3 AS (SELECT s2.* FROM s2 JOIN able ON s2.doc_id = able.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s3 a JOIN s3 b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM dw UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT dw.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id JOIN r ON dw.doc_id = r.doc_id GROUP BY dw.doc_id
"""
