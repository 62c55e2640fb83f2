import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import exchange as X


@pytest.mark.parametrize("bits", [0, 3])
def test_answers_equal_counts(spark, bits):
    rnd = np.random.default_rng(bits)
    pool = rnd.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    held = {b: rnd.choice(pool, rnd.integers(0, 60)) for b in (5, 2, 9, 11)}
    blocks = spark.createDataFrame([(b, bytearray(k.tobytes())) for b, k in held.items()], "block_id long, keys binary").repartition(3)

    def ask(batches):
        for row in X.each_block(batches):
            yield X.request(row["block_id"], np.frombuffer(row["keys"], dtype=np.uint64), None, bits)

    def read(batches):
        for row in X.each_block(batches):
            distinct, _ = X.condensed(np.frombuffer(row["keys"], dtype=np.uint64), None)
            shared, first = X.flags(distinct, row["r"], bits)
            yield pa.RecordBatch.from_arrays([pa.array([row["block_id"]] * len(distinct), pa.int64()), pa.array(distinct.view(np.int64)), pa.array(shared), pa.array(first)], ["b", "k", "s", "f"])

    out = X.attach(blocks, X.answers(blocks.mapInArrow(ask, X.REQUEST)), "r").mapInArrow(read, "b long, k long, s boolean, f boolean").collect()
    every = np.concatenate(list(held.values()))
    for r in out:
        key = np.array([r.k]).view(np.uint64)[0]
        where = [b for b, k in held.items() if key in k]
        shared = int((every == key).sum()) > 1
        assert (r.s, r.f) == (shared, shared and r.b == min(where))
    assert len(out) == sum(len(np.unique(k)) for k in held.values())
