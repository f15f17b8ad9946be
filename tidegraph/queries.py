"""Registered queries over the driver's tables, with equivalent SQL.

Graphs: ``ev`` has an edge user_id -> props.k for every event; ``sp`` is the
bipartite part/supplier graph (part 2p, supplier 2s+1), one edge per lineitem,
both directions. Operations: events in (ts, event_id) order, 'error' deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import graph as g
from .operators import ingest, primitives
from .plans import adaptive, bsp, monotonic
from .plans import algorithms as alg
from .sources import edgelist
from .sources.storage import materialize, shared_dir
from .streaming.driver import Engine, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS src, (props::JSON->>'k')::BIGINT AS dst FROM events)"
NV = f"WITH RECURSIVE {EV}, v AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM ev) + 1)) AS id)"
OPS = "ops AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_type = 'error' THEN 'd' ELSE 'a' END AS op, user_id AS src, (props::JSON->>'k')::BIGINT AS dst FROM events)"
#: The evolving case: events of the first half are the graph, those of the second half a batch, or so many of the stream.
BATCHES = 4


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_edges(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))


def ev(spark: SparkSession, d: str) -> g.Graph:
    return g.Graph.of(events_edges(spark, d))


def sp_edges(spark: SparkSession, d: str) -> DataFrame:
    one = _table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_quantity").alias("w"))
    return one.unionByName(g.swapped(one))


SP = "sp1 AS (SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_quantity AS w FROM lineitem), sp AS (SELECT * FROM sp1 UNION ALL SELECT dst, src, w FROM sp1)"


def event_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations with dense numbers: numbered within days, days added up; no task orders all events."""
    e = _table(spark, d, "events").select("ts", "event_id", F.when(F.col("event_type") == "error", "d").otherwise("a").alias("op"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))
    w = g.Window.partitionBy("day").orderBy("ts", "event_id")
    e = e.withColumn("day", F.to_date("ts"))
    e = e.withColumn("i", F.row_number().over(w))
    days = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    days = days.select("day", (F.sum("n").over(g.Window.orderBy("day")) - F.col("n")).alias("before"))
    return e.join(days, "day").select((F.col("before") + F.col("i") - 1).cast("long").alias("seq"), "op", "src", "dst", F.lit(None).cast("string").alias("reason"))


# ---- sources, sinks


@query("s03_degrees", f"{NV} SELECT id, (SELECT count(*) FROM ev WHERE dst = id) AS in_degree, (SELECT count(*) FROM ev WHERE src = id) AS out_degree FROM v")
def s03_degrees(spark, d):
    return ev(spark, d).degrees()


@query("s07_adjacency", f"WITH {EV} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM ev GROUP BY src")
def s07_adjacency(spark, d):
    return edgelist.adjacency(events_edges(spark, d)).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("s09_symmetrise", f"WITH {EV}, p AS (SELECT * FROM ev WHERE src <> dst) SELECT src, dst FROM p UNION SELECT dst, src FROM p")
def s09_symmetrise(spark, d):
    return g.symmetrise(events_edges(spark, d))


@query("s10_distinct_edges", f"WITH {SP} SELECT src, dst, min(w) AS w FROM sp GROUP BY src, dst")
def s10_distinct_edges(spark, d):
    return g.distinct_edges(sp_edges(spark, d))


@query("s11_offsets", f"{NV}, dg AS (SELECT id, count(ev.src) AS degree FROM v LEFT JOIN ev ON src = id GROUP BY id) SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS \"offset\" FROM dg")
def s11_offsets(spark, d):
    x = ev(spark, d)
    return edgelist.offsets(x.vertices, x.edges)


@query("s17_result_lines", f"{NV} SELECT id, concat_ws(' ', id, (SELECT count(*) FROM ev WHERE dst = id), (SELECT count(*) FROM ev WHERE src = id), printf('%.13f', id / 8)) AS line FROM v")
def s17_result_lines(spark, d):
    return edgelist.result_lines(ev(spark, d).degrees().withColumn("value", F.col("id") / 8), ["value"])


@query("s21_flags", f"{NV} SELECT id, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = id) AS seed FROM v")
def s21_flags(spark, d):
    return edgelist.flagged(ev(spark, d).vertices, _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), "seed")


@query("s23_compare", "WITH b AS (SELECT c_custkey AS id, c_acctbal AS a, c_acctbal + (c_custkey % 7) * 0.013 AS b FROM customer) SELECT power(10.0, -k) AS tolerance, count(*) FILTER (abs(a - b) > power(10.0, -k)) AS mismatches FROM b, (SELECT unnest(range(0, 4)) AS k) GROUP BY k")
def s23_compare(spark, d):
    a = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    b = a.select("id", (F.col("v") + (F.col("id") % 7) * 0.013).alias("v"))
    return primitives.compare(a, b, ["v"], 4)


# ---- update batches


@query("g01_parse", f"WITH {OPS} SELECT seq, op, src, dst FROM ops")
def g01_parse(spark, d):
    lines = event_ops(spark, d).select("seq", F.concat_ws("\t", "op", "src", "dst").alias("value"))
    return ingest.parse_ops(lines).where("reason IS NULL").drop("reason")


@query("g02_batches", f"WITH {OPS} SELECT (seq // 1000)::BIGINT AS batch, count(*) AS n, min(seq) AS first FROM ops GROUP BY ALL")
def g02_batches(spark, d):
    return ingest.batched(event_ops(spark, d), 1000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


_LEFT = "net AS (SELECT src, dst, count(*) FILTER (op = 'a') - count(*) FILTER (op = 'd') AS k FROM ops GROUP BY src, dst)"


@query("g05_cancel", f"WITH {OPS}, {_LEFT} SELECT src, dst, CASE WHEN k > 0 THEN 'a' ELSE 'd' END AS op, abs(k)::BIGINT AS n FROM net WHERE k <> 0")
def g05_cancel(spark, d):
    return ingest.cancelled(event_ops(spark, d))[0].groupBy("src", "dst", "op").agg(F.count(F.lit(1)).alias("n"))


@query("g06_distinct_ops", f"WITH {OPS} SELECT op, least(src, dst) AS u, greatest(src, dst) AS v, min(seq) AS seq FROM ops GROUP BY ALL")
def g06_distinct_ops(spark, d):
    x = ingest.distinct_ops(event_ops(spark, d), symmetric=True)
    return x.select("op", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "seq")


_HALF = f"WITH {OPS}, h AS (SELECT max(seq) // 2 AS h FROM ops), base AS (SELECT src, dst FROM ops, h WHERE seq <= h), ad AS (SELECT src, dst FROM ops, h WHERE seq > h AND op = 'a'), de AS (SELECT src, dst FROM ops, h WHERE seq > h AND op = 'd')"


def halves(spark, d):
    ops = event_ops(spark, d)
    h = F.broadcast(ops.agg(F.floor(F.max("seq") / 2).alias("h")))
    parts = ops.join(h)
    return parts.where("seq <= h").select("src", "dst"), parts.where("seq > h").drop("h")


@query("g07_missing_edges", f"{_HALF} SELECT src, dst, (count(*) - least(count(*), coalesce((SELECT count(*) FROM base b WHERE b.src = de.src AND b.dst = de.dst), 0)))::BIGINT AS n FROM de GROUP BY src, dst HAVING n > 0")
def g07_missing_edges(spark, d):
    base, ops = halves(spark, d)
    return g.unmatched_deletes(base, ops.where("op = 'd'")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g08_delete", f"{_HALF} SELECT src, dst, count(*) AS n FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM de) GROUP BY ALL")
def g08_delete(spark, d):
    base, ops = halves(spark, d)
    return g.delete_edges(base, ops.where("op = 'd'"))[0].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g09_delete_symmetric", f"{_HALF}, b2 AS (SELECT src, dst FROM base UNION ALL SELECT dst, src FROM base), d2 AS (SELECT src, dst FROM de UNION ALL SELECT dst, src FROM de) SELECT src, dst, count(*) AS n FROM (SELECT * FROM b2 EXCEPT ALL SELECT * FROM d2) GROUP BY ALL")
def g09_delete_symmetric(spark, d):
    base, ops = halves(spark, d)
    both = lambda x: x.unionByName(g.swapped(x))
    return g.delete_edges(both(base), both(ops.where("op = 'd'").select("src", "dst")))[0].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


_AFTER = f"{_HALF}, e2 AS ((SELECT * FROM base EXCEPT ALL SELECT * FROM de) UNION ALL SELECT * FROM ad)"


@query("g13_process_batch", f"{_AFTER} SELECT src, dst, count(*) AS n FROM e2 GROUP BY ALL")
def g13_process_batch(spark, d):
    base, ops = halves(spark, d)
    change, _ = ingest.process_batch(g.Graph.of(base), ops, ingest.Options(fixed_size=True))
    return change.after.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g11_add_symmetric", f"{_HALF} SELECT src, dst, count(*) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM ad UNION ALL SELECT dst, src FROM ad) GROUP BY ALL")
def g11_add_symmetric(spark, d):
    base, ops = halves(spark, d)
    adds = ops.where("op = 'a'").select("src", "dst")
    return g.apply(g.Graph.of(base), adds, adds.where("false"), symmetric=True).after.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g12_grow", "SELECT unnest(range(0, greatest((SELECT max(p_partkey) + 1 FROM part), (SELECT max(o_orderkey) + 1 FROM orders)))) AS id")
def g12_grow(spark, d):
    top = _table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    start = g.Graph.of(_table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst")))
    return start.grown(top).vertices


@query("g16_rejected", f"{_HALF}, net AS (SELECT o.src, o.dst, count(*) FILTER (op = 'a') AS a, count(*) FILTER (op = 'd') AS k FROM ops o, h WHERE seq > h GROUP BY o.src, o.dst), lone AS (SELECT src, dst, k - least(a, k) AS k, least(a, k) AS c FROM net), top AS (SELECT max(greatest(src, dst)) AS t FROM base), r AS (SELECT c, k, CASE WHEN greatest(src, dst) > t THEN k ELSE 0 END AS far, CASE WHEN greatest(src, dst) > t THEN 0 ELSE k - least(k, (SELECT count(*) FROM base b WHERE b.src = lone.src AND b.dst = lone.dst)) END AS gone FROM lone, top) SELECT * FROM (SELECT 'cancelled' AS reason, (2 * sum(c))::BIGINT AS n FROM r UNION ALL SELECT 'out of range', sum(far)::BIGINT FROM r UNION ALL SELECT 'no such edge', sum(gone)::BIGINT FROM r) WHERE n > 0")
def g16_rejected(spark, d):
    base, ops = halves(spark, d)
    return ingest.effective(g.Graph.of(base), ops)[2].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- algorithms

_PR = "SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.x / dg.n), 0) AS x"


def _pagerank_sql(edges: str, head: str, steps: int, epsilon: float = 0.0) -> str:
    new = "0.15 + 0.85 * coalesce(s.s, 0)"
    return f"{head}, dg AS (SELECT src, count(*) AS n FROM {edges} GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS x FROM v)" + "".join(
        f", r{i} AS (SELECT v.id, CASE WHEN abs({new} - o.x) > {epsilon} THEN {new} ELSE o.x END AS x FROM v JOIN r{i - 1} o ON o.id = v.id LEFT JOIN (SELECT e.dst, sum(r.x / dg.n) AS s FROM {edges} e JOIN dg ON dg.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst) s ON s.dst = v.id)" for i in range(1, steps + 1)
    ) + f" SELECT id, round(x, 6) AS rank FROM r{steps}"


@query("a01_pagerank", _pagerank_sql("ev", NV, 10))
def a01_pagerank(spark, d):
    return bsp.run(alg.pagerank(0.0, 10), ev(spark, d)).final.select("id", F.round("rank", 6).alias("rank"))


def evolving(spark, d) -> tuple[g.Graph, g.Change]:
    """The first half of the events, and the change of all operations of the second."""
    base, ops = halves(spark, d)
    graph = g.Graph.of(materialize(base, "base"))
    change = ingest.process_batch(graph, materialize(ops, "ops"), ingest.Options(fixed_size=True))[0]
    after = g.Graph(change.after.vertices, materialize(change.after.edges, "after"))
    return graph, g.Change(graph, after, materialize(change.added, "added"), materialize(change.deleted, "deleted"))


_V = "v AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM (SELECT * FROM base UNION ALL SELECT * FROM ad)) + 1)) AS id)"
_HV = f"{_AFTER}, {_V}".replace("WITH ops", "WITH RECURSIVE ops", 1)


def _stream_sql() -> str:
    """e2 after ``BATCHES`` batches: deletions of a batch meet the edges before it, then its additions come."""
    sql = f"{_HALF}, n AS (SELECT count(*) AS n, min(seq) AS low FROM ops, h WHERE seq > h), b0 AS (SELECT * FROM base)".replace("WITH ops", "WITH RECURSIVE ops", 1)
    for k in range(BATCHES):
        part = f"FROM ops, n WHERE seq >= low AND (seq - low) // (n // {BATCHES} + 1) = {k}"
        sql += f", b{k + 1} AS ((SELECT * FROM b{k} EXCEPT ALL SELECT src, dst {part} AND op = 'd') UNION ALL SELECT src, dst {part} AND op = 'a')"
    return f"{sql}, e2 AS (SELECT * FROM b{BATCHES}), {_V}"


@query("a02_pagerank_refine", _pagerank_sql("e2", _HV, 5))
def a02_pagerank_refine(spark, d):
    graph, change = evolving(spark, d)
    return bsp.refine(bsp.run(alg.pagerank(0.0, 5), graph), change).final.select("id", F.round("rank", 6).alias("rank"))


def _labels_sql(edges: str, head: str, steps: int) -> str:
    start = "((id + 3) * 1.23456::DOUBLE) % 0.5::DOUBLE AS p, ((id + 4) * 1.23456::DOUBLE) % 0.5::DOUBLE AS q"
    sql = f"{head}, w AS (SELECT src, dst, ((src + dst) * 1.7777777777::DOUBLE) % 0.5::DOUBLE AS w FROM {edges}), l0 AS (SELECT id, p / (p + q) AS x, q / (p + q) AS y FROM (SELECT id, {start} FROM v))"
    for i in range(1, steps + 1):
        sql += (
            f", l{i} AS (SELECT l.id, CASE WHEN keep THEN l.x ELSE mx / (mx + my) END AS x, CASE WHEN keep THEN l.y ELSE my / (mx + my) END AS y FROM (SELECT l.id, l.x, l.y, (s.a IS NULL OR s.a + s.b = 0 OR l.id IN (SELECT n_nationkey FROM nation)) AS keep, 0.15 * l.x + 0.85 * s.a / (s.a + s.b) AS mx, 0.15 * l.y + 0.85 * s.b / (s.a + s.b) AS my"
            f" FROM l{i - 1} l LEFT JOIN (SELECT w.dst, sum(w.w * r.x) AS a, sum(w.w * r.y) AS b FROM w JOIN l{i - 1} r ON r.id = w.src GROUP BY w.dst) s ON s.dst = l.id) l)"
        )
    return sql + f" SELECT id, round(x, 6) AS f0, round(y, 6) AS f1 FROM l{steps}"


def _nations(spark, d):
    return _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


@query("a03_label_propagation", _labels_sql("ev", NV, 5))
def a03_label_propagation(spark, d):
    r = bsp.run(alg.label_propagation(_nations(spark, d), epsilon=0.0, max_iters=5), ev(spark, d)).final
    return r.select("id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


def _coem_sql(edges: str, head: str, steps: int) -> str:
    sql = f"{head}, w AS (SELECT src, dst, ((src + dst) * 1.7777777777::DOUBLE) % 0.5::DOUBLE + 0.1::DOUBLE AS w FROM {edges}), iw AS (SELECT dst, sum(w) AS t FROM w GROUP BY dst), sd AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 1), c0 AS (SELECT id, CASE WHEN id IN (SELECT id FROM sd) THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM v)"
    for i in range(1, steps + 1):
        sql += f", c{i} AS (SELECT c.id, CASE WHEN c.id IN (SELECT id FROM sd) THEN c.x ELSE coalesce(s.s / s.t, 0) END AS x FROM c{i - 1} c LEFT JOIN (SELECT w.dst, sum(w.w * r.x) FILTER (r.id % 2 <> w.dst % 2) AS s, max(iw.t) AS t FROM w JOIN iw ON iw.dst = w.dst JOIN c{i - 1} r ON r.id = w.src GROUP BY w.dst) s ON s.dst = c.id)"
    return sql + f" SELECT id, round(x, 6) AS score FROM c{steps}"


@query("a04_coem", _coem_sql("ev", NV, 5))
def a04_coem(spark, d):
    return bsp.run(alg.coem(_nations(spark, d), epsilon=0.0, max_iters=5), ev(spark, d)).final.select("id", F.round("score", 6).alias("score"))


@query("a05_coem_refine", _coem_sql("e2", _HV, 4))
def a05_coem_refine(spark, d):
    graph, change = evolving(spark, d)
    return bsp.refine(bsp.run(alg.coem(_nations(spark, d), epsilon=0.0, max_iters=4), graph), change).final.select("id", F.round("score", 6).alias("score"))


def _als_sql(steps: int, regular: float, mod: float) -> str:
    sql = f"WITH RECURSIVE {SP}, v AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) FROM sp) + 1)) AS id), f0 AS (SELECT id, {mod}::DOUBLE * (id % 7 + 1) AS x, {mod}::DOUBLE * (id % 7 + 2) AS y FROM v)"
    for i in range(1, steps + 1):
        sql += (
            f", f{i} AS (SELECT f.id, CASE WHEN f.id % 2 <> {i % 2} THEN f.x ELSE coalesce((e * g - b * h) / (a * e - b * b), 0) END AS x, CASE WHEN f.id % 2 <> {i % 2} THEN f.y ELSE coalesce((a * h - b * g) / (a * e - b * b), 0) END AS y FROM f{i - 1} f LEFT JOIN "
            f"(SELECT sp.dst, sum(r.x * r.x) + {regular}::DOUBLE AS a, sum(r.x * r.y) AS b, sum(r.y * r.y) + {regular}::DOUBLE AS e, sum(sp.w * r.x) AS g, sum(sp.w * r.y) AS h FROM sp JOIN f{i - 1} r ON r.id = sp.src GROUP BY sp.dst) s ON s.dst = f.id)"
        )
    return sql + f" SELECT id, round(x, 4) AS x0, round(y, 4) AS x1 FROM f{steps}"


@query("a06_als", _als_sql(4, 0.1, 0.3))
def a06_als(spark, d):
    r = bsp.run(alg.als(None, mod=0.3, regular=0.1, epsilon=0.0, max_iters=4, hashed=False), g.Graph.of(sp_edges(spark, d))).final
    return r.select("id", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"))


def _hash_sql(source: str) -> str:
    """The 64-bit hash of a non-negative number as HUGEINT, staged in subqueries."""
    top = 1 << 64
    sql = f"SELECT *, ({source})::HUGEINT AS h FROM src"
    for first, constant, second, shift in scalar.HASH_STEPS:
        left = f"((h + {constant}) % {top})" if first == "+" else f"xor(h::UBIGINT, {constant}::UBIGINT)::HUGEINT"
        right = f"((h * {1 << shift}) % {top})" if shift > 0 else f"(h // {1 << -shift})"
        both = f"(({left} + {right}) % {top})" if second == "+" else f"xor({left}::UBIGINT, {right}::UBIGINT)::HUGEINT"
        sql = f"SELECT * REPLACE ({both} AS h) FROM ({sql})"
    return sql


_X = " JOIN ".join(f"(SELECT id, (((h + 5) % {1 << 64})::DOUBLE) % 0.00190000001::DOUBLE AS x{i} FROM ({_hash_sql(f'id * 2 + {i}')})) q{i}" + (" USING (id)" if i else "") for i in range(2))


@query("a07_als_start", f"{NV}, src AS (SELECT id FROM v) SELECT id, id % 2 = 1 AS part, x0, x1 FROM {_X}")
def a07_als_start(spark, d):
    p = alg.als()
    return p.init(p.side(ev(spark, d))).select("id", "part", "x0", "x1")


def _hops():
    return F.coalesce("level", F.lit(-1).cast("long")).alias("level")


def _paths_sql(edges: str, head: str, cost: str) -> str:
    return (
        f"{head}, e AS (SELECT DISTINCT src, dst, {cost} AS c FROM {edges}), walk AS (SELECT 0::BIGINT AS id, 0::BIGINT AS value, 0::BIGINT AS level UNION SELECT e.dst, w.value + e.c, w.level + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.level < 24), "
        "best AS (SELECT id, min(value) AS value FROM walk GROUP BY id), hop AS (SELECT w.id, w.value, min(w.level) AS level FROM walk w JOIN best b ON b.id = w.id AND b.value = w.value GROUP BY ALL)"
    )


@query("a09_shortest_paths", _paths_sql("ev", NV, "(src + dst) % 5 + 1") + " SELECT v.id, coalesce(hop.value, 65535) AS value, coalesce(level, -1) AS level FROM v LEFT JOIN hop ON hop.id = v.id")
def a09_shortest_paths(spark, d):
    return monotonic.run(alg.shortest_paths(0), ev(spark, d)).result().select("id", "value", _hops())


@query("a10_reachability", _paths_sql("ev", NV, "0") + " SELECT v.id, (hop.value IS NOT NULL)::INT AS value, coalesce(level, -1) AS level FROM v LEFT JOIN hop ON hop.id = v.id")
def a10_reachability(spark, d):
    return alg.reached(monotonic.run(alg.reachability(0), ev(spark, d))).select("id", "value", _hops())


@query("k09_paths_refine", _paths_sql("e2", _HV, "(src + dst) % 5 + 1") + " SELECT v.id, coalesce(hop.value, 65535) AS value, coalesce(level, -1) AS level FROM v LEFT JOIN hop ON hop.id = v.id")
def k09_paths_refine(spark, d):
    graph, change = evolving(spark, d)
    return monotonic.refine(monotonic.run(alg.shortest_paths(0), graph), change).result().select("id", "value", _hops())


@query("t01_stream_paths", _paths_sql("e2", _stream_sql(), "(src + dst) % 5 + 1") + " SELECT v.id, coalesce(hop.value, 65535) AS value, coalesce(level, -1) AS level FROM v LEFT JOIN hop ON hop.id = v.id")
def t01_stream_paths(spark, d):
    """All operations of the second half as files that a stream reads, one micro-batch each."""
    base, ops = halves(spark, d)
    ops = materialize(ops.drop("reason"), "ops")
    place = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    ingest.replay(ops, ops.count() // BATCHES + 1, f"{place}/ops")
    engine = Engine(alg.shortest_paths(0), g.Graph.of(base), ingest.Options(fixed_size=True)).start()
    stream(spark, engine, f"{place}/ops", f"{place}/offsets").awaitTermination()
    return engine.state.result().select("id", "value", _hops())


@query("u13_pagerank_epsilon", _pagerank_sql("ev", NV, 6, 0.01))
def u13_pagerank_epsilon(spark, d):
    """Values move only by more than epsilon; the frontier shrinks."""
    return bsp.run(alg.pagerank(0.01, 6), ev(spark, d)).final.select("id", F.round("rank", 6).alias("rank"))


@query("a12_labels_refine", _labels_sql("e2", _HV, 3))
def a12_labels_refine(spark, d):
    graph, change = evolving(spark, d)
    r = bsp.refine(bsp.run(alg.label_propagation(_nations(spark, d), epsilon=0.0, max_iters=3), graph), change).final
    return r.select("id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


@query("a11_components", "WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM (SELECT s_nationkey AS s, 100 + s_suppkey AS t FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 100 + s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0)), v AS (SELECT unnest(range(0, (SELECT max(greatest(s, t)) FROM e) + 1)) AS id), r AS (SELECT id, id AS c FROM v UNION SELECT e.t, r.c FROM r JOIN e ON e.s = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def a11_components(spark, d):
    s = _table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") + 100).alias("dst"))
    return alg.connected_components(g.Graph.of(s))


# ---- joins, aggregates, scans, scalars


@query("h06_in_weights", f"WITH {SP} SELECT dst AS id, sum(w) AS in_weight FROM sp GROUP BY dst")
def h06_in_weights(spark, d):
    return sp_edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in_weight"))


@query("h11_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def h11_least_squares(spark, d):
    f = adaptive.fit(_table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("work")))
    return f.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("h13_out_neighbours", f"WITH {EV} SELECT count(*) AS n FROM ev WHERE src IN (SELECT n_nationkey FROM nation) AND dst % 2 = 0")
def h13_out_neighbours(spark, d):
    return primitives.out_neighbours(events_edges(spark, d), _nations(spark, d), F.col("dst") % 2 == 0)


@query("e16_active_edges", f"WITH {EV} SELECT count(*) AS n FROM ev WHERE src IN (SELECT n_nationkey FROM nation)")
def e16_active_edges(spark, d):
    return primitives.active_edges(_nations(spark, d), ev(spark, d).degrees())


@query("w01_scans", "SELECT o_orderkey, (count(*) OVER f - 1)::BIGINT AS before, min(o_custkey) OVER b AS least FROM orders WINDOW f AS (ORDER BY o_orderkey), b AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def w01_scans(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(1).cast("long").alias("one"))
    x = primitives.scan(o, "o_orderkey", "one", "before", inclusive=False)
    return primitives.fill_from_right(x, "o_orderkey", "o_custkey", "least").select("o_orderkey", "before", "least")


@query("w04_pack", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F'")
def w04_pack(spark, d):
    return primitives.pack(_table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderkey").select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("w17_bits", "SELECT count(*) FILTER (c_acctbal > 0) AS n FROM customer")
def w17_bits(spark, d):
    return primitives.set_bits(_table(spark, d, "customer").withColumn("f", F.col("c_acctbal") > 0), "f")


@query("f01_fmod", "SELECT c_custkey, (c_acctbal * 1.7777777777::DOUBLE) % 0.5::DOUBLE AS r, abs(c_acctbal) AS a FROM customer")
def f01_fmod(spark, d):
    return _table(spark, d, "customer").select("c_custkey", ((F.col("c_acctbal") * 1.7777777777) % 0.5).alias("r"), F.abs("c_acctbal").alias("a"))


@query("f04_hash", f"WITH src AS (SELECT c_custkey FROM customer) SELECT c_custkey, (CASE WHEN h >= {1 << 63} THEN h - {1 << 64} ELSE h END)::BIGINT AS hash FROM ({_hash_sql('c_custkey')})")
def f04_hash(spark, d):
    return scalar.with_hash(_table(spark, d, "customer").select("c_custkey"), F.col("c_custkey"), "hash")


@query("f06_inverse", "WITH m AS (SELECT s_suppkey, s_suppkey + 2.0 AS a, 1.0 AS b, 3.0 AS c, 5.0 AS e FROM supplier) SELECT s_suppkey, round(e / (a * e - b * c), 9) AS i0, round(a / (a * e - b * c), 9) AS i3, round(a * e - b * c, 6) AS det FROM m")
def f06_inverse(spark, d):
    m = _table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey") + 2.0, F.lit(1.0), F.lit(3.0), F.lit(5.0)).alias("m"))
    i = m.withColumn("i", scalar.inverse2(F.col("m")))
    return i.select("s_suppkey", F.round(F.get("i", F.lit(0)), 9).alias("i0"), F.round(F.get("i", F.lit(3)), 9).alias("i3"), F.round(scalar.determinant2(F.col("m")), 6).alias("det"))


@query("f05_matrix", "SELECT s_suppkey, s_suppkey + 4.0 AS p0, 3.0 * s_suppkey + 10.0 AS p1, s_suppkey * 2.0 AS o1 FROM supplier")
def f05_matrix(spark, d):
    """A 2 x 2 matrix by a vector, and an outer product."""
    m = _table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey").cast("double"), F.lit(2.0), F.col("s_suppkey") * 3.0, F.lit(5.0)).alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"), F.array(F.col("s_suppkey").cast("double"), F.lit(2.0)).alias("u"))
    m = m.withColumns({"p": scalar.matmul(F.col("m"), F.col("v"), 2, 2, 1), "o": scalar.outer(F.col("u"), 2)})
    return m.select("s_suppkey", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"), F.get("o", F.lit(1)).alias("o1"))


@query("s01_transpose", f"WITH {EV} SELECT dst AS src, src AS dst, count(*) AS n FROM ev GROUP BY ALL")
def s01_transpose(spark, d):
    return g.transpose(events_edges(spark, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _file(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/file-{uuid.uuid4().hex}"


@query("s02_adjacency_file", f"WITH {SP} SELECT src, dst, count(*) AS n, sum(w) AS w FROM sp GROUP BY ALL")
def s02_adjacency_file(spark, d):
    """A weighted adjacency file, written and read again."""
    path, x = _file(spark), g.Graph.of(sp_edges(spark, d))
    edgelist.write_adjacency(x.vertices, x.edges.withColumn("payload", F.col("w").cast("string")).drop("w"), path, "payload")
    back = edgelist.read_adjacency(spark, path)[1]
    return back.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("payload").cast("double")).alias("w"))


@query("s05_edge_list", f"WITH {SP} SELECT src, dst, count(*) AS n, sum(w) AS w FROM sp GROUP BY ALL")
def s05_edge_list(spark, d):
    """A weighted edge list with a comment, written and read again."""
    path = _file(spark)
    lines = sp_edges(spark, d).select(F.concat_ws("\t", "src", "dst", F.col("w").cast("string")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# src dst w",)], "value string")).write.text(path)
    back = edgelist.read_edge_list(spark, path, True)
    return back.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("payload").cast("double")).alias("w"))


@query("g03_fixed_batches", f"WITH {OPS}, k AS (SELECT *, src % 7 <> 0 AS usable FROM ops), c AS (SELECT (sum(usable::INT) OVER (ORDER BY seq) - usable::INT) // 1000 AS batch, usable FROM k) SELECT batch::BIGINT AS batch, count(*) AS n, count(*) FILTER (usable) AS usable FROM c GROUP BY ALL")
def g03_fixed_batches(spark, d):
    """Batches of 1000 usable operations; the others go with the batch that reads them."""
    ops = event_ops(spark, d).withColumn("reason", F.when(F.col("src") % 7 == 0, "left out"))
    return ingest.batched(ops, 1000, fixed=True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("usable"))
