import numpy as np
import pyarrow as pa
from lodestone.operators import vectors


def _packed(n_rows, n_queries, dim):
    """Rows that one block of queries may all see."""
    x = np.random.default_rng(1).normal(size=(n_rows, dim)).astype(np.float32)
    batch = pa.record_batch({"blk": pa.array(np.zeros(n_rows, np.int64)), "vector": list(x), "id": pa.array(np.arange(n_rows)), "pos": [np.arange(n_queries)] * n_rows})
    return x, list(vectors._packed_pairs(iter([batch])))


def test_blocks_of_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 1_000)
    x, parts = _packed(300, 64, 4)
    sizes = [len(np.frombuffer(b.column("pos")[0].as_buffer(), np.int32)) for b in parts]
    assert max(sizes) <= 1_000 and sum(sizes) == 300 * 64
    q = np.random.default_rng(2).normal(size=(64, 4)).astype(np.float32)
    asked = [pa.array([v], pa.binary()) for v in (np.arange(64).tobytes(), q.tobytes())]
    hits = []
    for b in parts:
        met = pa.RecordBatch.from_arrays([b.column("dim"), *asked, *(b.column(c) for c in ("ids", "data", "rows", "pos"))], ["dim", "q_ids", "q_data", "ids", "data", "rows", "pos"])
        hits += [r for o in vectors._best_of_pairs(3, "IP")(iter([met])) for r in o.to_pylist()]
    best = {i: sorted((-round(h["score"], 12), h["id"]) for h in hits if h["query_id"] == i)[:3] for i in range(64)}
    s = np.round((q[:, None].astype(float) * x[None].astype(float)).sum(axis=2), 12)
    assert {i: [k for _, k in v] for i, v in best.items()} == {i: list(np.lexsort((np.arange(300), -s[i]))[:3]) for i in range(64)}
