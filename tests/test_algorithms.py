"""Algorithms on the sample graph against independently derived values, and refinement against a fresh run."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators.graph import Graph
from tidegraph.operators.ingest import Options, parse_ops, process_batch
from tidegraph.plans import algorithms as alg
from tidegraph.plans import bsp, monotonic

G0 = [(1, 2), (2, 3), (2, 4), (3, 4), (5, 4), (6, 7), (6, 5), (7, 8), (8, 5), (8, 2), (10, 12), (11, 20), (12, 19), (19, 12), (18, 20), (14, 21), (13, 17), (16, 14), (16, 14), (17, 16)]
OPS = "a 12 15|d 6 5|a 16 17|d 10 12|a 19 12|d 13 17|a 16 12|d 16 14|a 9 5|d 3 4|d 16 14".split("|")
SEEDS, MEMBERS = [0, 1, 3, 8, 10, 12], [1, 6, 7, 10, 11, 13, 14, 15, 20]


def graph(spark, edges=G0):
    return Graph.of(spark.createDataFrame(edges, "src long, dst long"))


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def changed(spark, g, ops=OPS):
    lines = spark.createDataFrame(list(enumerate(ops)), "seq long, value string")
    return process_batch(g, parse_ops(lines))[0]


def values(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.select("id", *columns).collect()}


def test_pagerank(spark):
    want = [0.15, 0.15, 0.418467, 0.327849, 0.908029, 0.354717, 0.15, 0.21375, 0.331688, 0.15, 0.15, 0.15, 1.369004, 0.15, 0.477994, 0.15, 0.385875, 0.2775, 0.15, 1.480996, 0.405, 0.556295]
    got = values(bsp.run(alg.pagerank(), graph(spark)).final, "rank")
    assert [round(got[i][0], 6) for i in range(22)] == want


def test_label_propagation(spark):
    want = [0.317298, 0.717203, 0.479297, 0.741625, 0.468546, 0.218264, 0.243167, 0.245086, 0.202998, 0.864615, 0.147935, 0.939121, 0.067807, 0.341616, 0.353314, 0.327204, 0.341703, 0.33686, 0.726454, 0.072778, 0.865642, 0.35571]
    run = bsp.run(alg.label_propagation(ids(spark, SEEDS)), graph(spark))
    assert [round(v[0], 6) for _, v in sorted(values(run.final, "f0").items())] == want
    assert len(run.states) - 1 == 6


def test_coem(spark):
    got = {k: round(v[0], 6) for k, v in values(bsp.run(alg.coem(ids(spark, SEEDS), ids(spark, MEMBERS)), graph(spark)).final, "score").items() if v[0]}
    assert got == {1: 1.0, 10: 1.0, 2: 0.534247, 12: 0.5}


def test_als(spark):
    from tidegraph.operators.graph import symmetrise

    g = graph(spark)
    got = values(bsp.run(alg.als(ids(spark, MEMBERS)), Graph(g.vertices, symmetrise(g.edges))).final, "x0", "x1")
    want = {1: (0.099118, 0.955425), 6: (0.21676, 0.361489), 7: (0.425958, 0.472668), 13: (0.261473, 0.22898), 20: (0.199697, 0.954008), 2: (0.000156, 0.001502)}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


def test_paths(spark):
    got = values(monotonic.run(alg.shortest_paths(6), graph(spark)).result(), "value")
    assert {k: v[0] for k, v in got.items() if v[0] != 65535} == {2: 6, 3: 7, 4: 7, 5: 2, 6: 0, 7: 4, 8: 5}
    reach = values(alg.reached(monotonic.run(alg.reachability(6), graph(spark))), "value", "level")
    assert {k: v[1] for k, v in reach.items() if v[0]} == {6: 0, 5: 1, 7: 1, 4: 2, 8: 2, 2: 3, 3: 4}


def test_components(spark):
    got = values(alg.connected_components(graph(spark)), "component")
    assert got[8] == (1,) and got[19] == (10,) and got[18] == (11,) and got[17] == (13,) and got[0] == (0,)


@pytest.mark.parametrize("name", ["pagerank", "labels", "coem", "als"])
def test_refinement_equals_fresh_run(spark, name):
    seeds, members = ids(spark, SEEDS), ids(spark, MEMBERS)
    program = {"pagerank": alg.pagerank(0.0, 3), "labels": alg.label_propagation(seeds, epsilon=0.01, max_iters=3), "coem": alg.coem(seeds, None, epsilon=0.0, max_iters=3), "als": alg.als(members, epsilon=0.0, mod=0.9, regular=0.01, max_iters=3)}[name]
    g = graph(spark)
    change = changed(spark, g, [*OPS, "a 21 23"])
    got = values(bsp.refine(bsp.run(program, g), change).final, *program.values)
    want = values(bsp.run(program, change.after).final, *program.values)
    assert got.keys() == want.keys() and len(got) == 24
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("ops", [OPS, ["d 6 5"], ["d 8 2"], ["a 0 6", "d 6 6"]])
def test_path_refinement_equals_fresh_run(spark, ops):
    g = graph(spark)
    change = changed(spark, g, ops)
    for program in (alg.shortest_paths(6), alg.reachability(6)):
        old = monotonic.run(program, g)
        assert values(monotonic.refine(old, change).state, "value", "level") == values(monotonic.run(program, change.after).state, "value", "level")


def test_hash_agrees(spark):
    import numpy as np

    from tidegraph.functions.scalar import hash64, with_hash

    rows = with_hash(spark.range(50), F.col("id") * 977, "h").orderBy("id").collect()
    assert [r["h"] for r in rows] == hash64(np.arange(50) * 977).view(np.int64).tolist()


def test_batch_rules(spark):
    g = graph(spark)
    run = lambda ops, **o: process_batch(g, parse_ops(spark.createDataFrame(list(enumerate(ops)), "seq long, value string")), Options(**o))
    change, rejected = run(["a 1 9", "d 1 9", "a 3 7", "a 3 7", "d 3 7", "# x", "a 1", "x 1 2", "d 99 1", "d 1 21", "d 16 14"])
    assert sorted(map(tuple, change.added.collect())) == [(3, 7)]
    assert change.after.edges.where("src = 16 AND dst = 14").count() == 1
    reasons = {r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()}
    assert reasons == {"cancelled": 4, "comment": 1, "wrong arity": 1, "unknown operation": 1, "out of range": 1, "no such edge": 1}
    change, _ = run(["a 1 2", "a 5 6", "a 5 6"], simple=True)
    assert sorted(map(tuple, change.added.collect())) == [(5, 6)]
    change, _ = run(["a 21 30", "a 5 5"])
    assert change.after.vertices.count() == 31
    change, _ = run(["a 4 9"], symmetric=True)
    assert sorted(map(tuple, change.added.collect())) == [(4, 9), (9, 4)]
