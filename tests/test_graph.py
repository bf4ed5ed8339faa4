import random

from lodestone.operators import graph


def test_hops_are_dealt_by_the_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_OF_TASK", 20)
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    edges = spark.createDataFrame([(a, "r", b) for a, b in pairs * 3], "source_entity string, relation_type string, target_entity string")
    start = {(q, f"n{q * s % 60}") for q in range(5) for s in (7, 11)}
    found = graph.expand(spark.createDataFrame(sorted(start), "query_id long, entity string"), edges, 2)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(q, n): (0, [n]) for q, n in start}
    for hop in (1, 2):
        new = {}
        for (q, n), (h, path) in want.items():
            for m in near.get(n, ()) if h == hop - 1 else ():
                if (q, m) not in want:
                    new[q, m] = min(new.get((q, m), (hop, [*path, m])), (hop, [*path, m]))
        want |= new
    assert {(r.query_id, r.entity): (r.hop, r.path) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(a#") and ", 27), REPARTITION_BY_NUM" in plan  # 2 * 270 edges, 20 a task
