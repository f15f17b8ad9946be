"""Files, primitives, the stream, the cost model and the registered queries' names."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import scalar
from tidegraph.operators import graph as g
from tidegraph.operators import ingest, primitives
from tidegraph.plans import algorithms as alg
from tidegraph.plans import bsp, monotonic
from tidegraph.plans.adaptive import Adaptive
from tidegraph.sources import edgelist
from tidegraph.streaming.driver import Engine, stream

from .test_algorithms import G0, OPS, changed, graph, values


def test_edge_list_and_adjacency_files(spark, tmp_path):
    (tmp_path / "g.snap").write_text("# comment\n" + "\n".join(f"{a}\t{b}" for a, b in G0))
    edges = edgelist.read_edge_list(spark, str(tmp_path / "g.snap"))
    assert sorted(map(tuple, edges.collect())) == sorted(G0)
    edgelist.snap_to_adjacency(spark, str(tmp_path / "g.snap"), str(tmp_path / "g.adj"))
    vertices, back = edgelist.read_adjacency(spark, str(tmp_path / "g.adj"))
    assert vertices.count() == 22 and sorted(map(tuple, back.select("src", "dst").collect())) == sorted(G0)
    weighted = back.select("src", "dst", (F.col("src") * 2).cast("string").alias("payload"))
    edgelist.write_adjacency(vertices, weighted, str(tmp_path / "w.adj"), "payload")
    _, again = edgelist.read_adjacency(spark, str(tmp_path / "w.adj"))
    assert sorted((r["src"], r["dst"], r["payload"]) for r in again.collect()) == sorted((a, b, str(2 * a)) for a, b in G0)
    (tmp_path / "bad.adj").write_text("AdjacencyGraph\n2\n1\n0\n1\n")
    with pytest.raises(ValueError):
        edgelist.read_adjacency(spark, str(tmp_path / "bad.adj"))


def test_symmetric_conversion(spark):
    assert {tuple(r) for r in g.symmetrise(graph(spark, [(1, 2), (2, 1), (1, 2), (3, 3)]).edges).collect()} == {(1, 2), (2, 1)}


def test_side_files_and_results(spark, tmp_path):
    (tmp_path / "seeds").write_text("0\n1\n3 8\n10\n12\nx\n")
    seeds = edgelist.read_ids(spark, str(tmp_path / "seeds"))
    assert sorted(r[0] for r in seeds.collect()) == [0, 1, 3, 8, 10, 12]
    r = bsp.run(alg.pagerank(max_iters=2), graph(spark))
    edgelist.write_result(r.result(), str(tmp_path / "out"), 0, ["rank"])
    back = edgelist.read_result(spark, str(tmp_path / "out"), 0, ["rank"])
    assert [x["mismatches"] for x in primitives.compare(r.result(), back, ["rank"]).collect()] == [0] * 6
    moved = back.withColumn("rank", F.col("rank") + F.when(F.col("id") == 3, 0.05).otherwise(0.0))
    assert [x["mismatches"] for x in primitives.compare(r.result(), moved, ["rank"]).orderBy(F.desc("tolerance")).collect()] == [0, 0, 1, 1, 1, 1]
    assert [x["id"] for x in primitives.differences(r.result(), moved, ["rank"], 0.01).collect()] == [3]
    assert r.history([3]).count() == len(r.states)


def test_scans_cross_blocks(spark):
    rng = random.Random(4)
    rows = [(k * 9001, rng.randrange(100)) for k in range(40)]
    df = spark.createDataFrame(rows, "i long, v long")
    vs = [v for _, v in rows]
    for how, f in (("sum", sum), ("min", min), ("max", max)):
        for inclusive in (True, False):
            for backward in (False, True):
                got = [r["s"] for r in primitives.scan(df, "i", "v", "s", how, inclusive, backward).orderBy("i").collect()]
                for k, x in enumerate(got):
                    part = vs[k + (not inclusive) :] if backward else vs[: k + inclusive]
                    assert x == (f(part) if part else 0 if how == "sum" else None)


def test_matrices(spark):
    df = spark.createDataFrame([([2.0, 1.0, 1.0, 3.0], [1.0, 2.0], [4.0, 2.0, 2.0, 1.0])], "m array<double>, v array<double>, s array<double>")
    r = df.select(scalar.inverse2(F.col("m")).alias("i"), scalar.inverse(F.col("m")).alias("j"), scalar.inverse2(F.col("s")).alias("none"), scalar.outer(F.col("v"), 2).alias("o"), scalar.matmul(F.col("m"), F.col("v"), 2, 2, 1).alias("p"), scalar.elementwise(F.col("v"), F.col("v"), -1).alias("z"), scalar.scaled(F.col("v"), 3.0).alias("t")).first()
    assert r["i"] == pytest.approx([0.6, -0.2, -0.2, 0.4]) and r["j"] == pytest.approx(r["i"]) and r["none"] == [None] * 4
    assert (r["o"], r["p"], r["z"], r["t"]) == ([1, 2, 2, 4], [4, 7], [0, 0], [3, 6])


def test_stream_of_batches(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate([*OPS, "a 9 10", "# note"])), "seq long, value string")
    ops = ingest.parse_ops(lines).where("reason IS NULL").drop("reason")
    assert ingest.replay(ops, 5, str(tmp_path / "ops")) == 3
    engine = Engine(alg.shortest_paths(6), graph(spark), output=str(tmp_path / "out"), values=("value",)).start()
    stream(spark, engine, str(tmp_path / "ops"), str(tmp_path / "check")).awaitTermination()
    assert engine.version == 3 and engine.graph.edges.count() == 20
    want = values(monotonic.run(alg.shortest_paths(6), engine.graph).result(), "value")
    got = {r["id"]: (int(r["value"]),) for r in edgelist.read_result(spark, str(tmp_path / "out"), 3, ["value"]).collect()}
    assert got == want
    before = engine.version
    engine.batch(ingest.parse_ops(spark.createDataFrame([(0, "a 1 9"), (1, "d 1 9")], "seq long, value string")))  # nothing is left of it
    assert engine.version == before + 1 and values(engine.state.result(), "value") == want


def test_restart_between_batches(spark, tmp_path):
    """An engine that stops after two batches, and a new one that goes on, give what an unbroken run gives."""
    rng = random.Random(9)
    folder = tmp_path / "ops"
    folder.mkdir()

    def put(k):
        (folder / f"{k}").write_text("".join(f"{rng.choice('aad')} {rng.randrange(12)} {rng.randrange(12)}\n" for _ in range(6)))

    new = lambda home: Engine(alg.pagerank(0.0, 2), graph(spark), home=home)
    put(1), put(2)
    home, check = str(tmp_path / "home"), str(tmp_path / "check")
    stream(spark, new(home).start(), str(folder), check).awaitTermination()
    put(3)
    second = new(home).start()
    assert (second.version, second.last) == (2, 1)
    stream(spark, second, str(folder), check).awaitTermination()
    whole = new(None).start()
    stream(spark, whole, str(folder), str(tmp_path / "other")).awaitTermination()
    assert second.version == whole.version == 3
    one, two = values(second.state.final, "rank"), values(whole.state.final, "rank")
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in two)


def test_replayed_batches(spark):
    lines = spark.createDataFrame(list(enumerate([*OPS, "# note", "a 9 10", "a 3 4"])), "seq long, value string")
    engine = Engine(alg.shortest_paths(6), graph(spark), ingest.Options(fixed_size=True), adaptive=Adaptive()).start().replayed(lines, 3, most=2)
    assert engine.version == 2 and len(engine.counts) == 2
    assert values(engine.state.result(), "value") == values(monotonic.run(alg.shortest_paths(6), engine.graph).result(), "value")


def test_replay_keeps_the_order(spark, tmp_path):
    ops = spark.range(5000).selectExpr("id AS seq", "'a' AS op", "id AS src", "id + 1 AS dst").repartition(7)
    assert ingest.replay(ops, 2000, str(tmp_path / "r")) == 3
    for k in range(3):
        text = "".join(f.read_text() for f in sorted((tmp_path / "r" / f"batch={k}").glob("part*")))
        assert [int(x.split()[1]) for x in text.splitlines()] == list(range(2000 * k, min(5000, 2000 * k + 2000)))


def test_frontier_and_refinement_equal_full_runs(spark, monkeypatch):
    """Signed rows give what summing all messages gives, for several programs and random batches."""
    rng = random.Random(5)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(70)]
    x = graph(spark, edges)
    change = changed(spark, x, [f"a {rng.randrange(23)} {rng.randrange(23)}" for _ in range(5)] + [f"d {a} {b}" for a, b in rng.sample(edges, 12)])
    none = spark.createDataFrame([(3,)], "id long")
    for p, names in ((alg.pagerank(0.02, 8), ["rank"]), (alg.label_propagation(none, epsilon=0.0, max_iters=4), ["f0", "f1"]), (alg.coem(none, epsilon=0.001, max_iters=5), ["score"])):
        monkeypatch.setattr(bsp, "FEW", 10**9)
        plain = values(bsp.run(p, change.after).final, *names)
        monkeypatch.setattr(bsp, "FEW", 1)
        for got in (bsp.run(p, change.after).final, bsp.refine(bsp.run(p, x), change).final):
            got = values(got, *names)
            assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k], abs=1e-9) for k in plain), p.name


def test_adaptive_switch(spark):
    g0 = graph(spark)
    old = bsp.run(alg.pagerank(0.0, 3), g0)
    change = changed(spark, g0)
    a = Adaptive()
    first = a.advance(old, change)
    assert a.decisions == ["refine"] and a.samples
    a.samples, a.last_full = [(1.0, 9.0), (2.0, 10.0)], 1.0
    second = a.advance(old, change)
    assert a.decisions[-1] == "recompute"
    one, two = values(first.final, "rank"), values(second.final, "rank")
    assert all(one[k] == pytest.approx(two[k]) for k in two) and len(one) == len(two)


def test_random_batches_refine_paths(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(15), rng.randrange(15)) for _ in range(40)]
    x = graph(spark, edges)
    ops = [f"a {rng.randrange(17)} {rng.randrange(17)}" for _ in range(6)] + [f"d {a} {b}" for a, b in rng.sample(edges, 8)]
    change = changed(spark, x, ops)
    p = alg.shortest_paths(edges[0][0])
    assert values(monotonic.refine(monotonic.run(p, x), change).state, "value", "level") == values(monotonic.run(p, change.after).state, "value", "level")


def test_command_line(spark, tmp_path):
    from tidegraph.__main__ import main

    (tmp_path / "g.snap").write_text("\n".join(f"{a} {b} {a + b}" for a, b in G0))
    (tmp_path / "ops").mkdir()
    (tmp_path / "ops" / "1").write_text("a 8 9 4\nd 6 5 0\n")
    engine = main(["paths", str(tmp_path / "g.snap"), "--weighted", "--source", "6", "--output", str(tmp_path / "out"), "--stream", str(tmp_path / "ops"), "--checkpoint", str(tmp_path / "c")], spark)
    assert engine.version == 1
    got = values(engine.state.result(), "value")
    assert got[9] == (32,) and got[5] == (41,) and got[7] == (13,)
    assert [r["mismatches"] for r in main(["compare", str(tmp_path / "out"), str(tmp_path / "out")], spark).collect()] == [0] * 6


def test_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "a01_pagerank" in e.queries()
