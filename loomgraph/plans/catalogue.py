"""Every query over the order tables, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, endpoints
from loomgraph.operators import adjacency, messages, profile, updates
from loomgraph.plans import components, frontier, label_propagation, pagerank, triangles
from loomgraph.runtime import scratch
from loomgraph.sources import derive, edge_binary, edge_text, rmat
from loomgraph.streaming import ingest

ROOT = 1
ITERATIONS = 10
SPARSE = 35
OFFSET = 7
SPLIT = 100
#: A mean change of ranks that the co-order graphs reach in a few iterations.
TOL = 0.05


#: Sums of doubles differ in the last places with their order. Ranks that are decimals of seven places with a 5 at the end would be rounded by these;
#: with this much more on either side, all round up.
NUDGE = 1e-9


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("rank") + NUDGE, 6).alias("rank"))


def parts_n(spark: SparkSession, folder: str) -> int:
    return derive.parts(spark, folder).count()


def _source(spark: SparkSession, vertex: int = ROOT) -> DataFrame:
    return spark.range(vertex, vertex + 1)


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Each vertex with the one OFFSET places on, and the pairs of a part and its order's next part by line 1: hits and misses."""
    miss = derive.parts(s, d).select(F.col("id").alias("src"), (F.col("id") + OFFSET).alias("dst"))
    return miss.union(derive.sparse(s, d).edges.select("src", "dst"))


def _grown(s: SparkSession, d: str) -> Graph:
    """The sparse graph after a batch: heavier lines' edges, reversed, arrive with weight 0."""
    return updates.insert_edges(derive.sparse(s, d), _batch(s, d))


def _active_degree(s: SparkSession, d: str) -> DataFrame:
    active = derive.parts(s, d).where("id % 3 = 0")
    return messages.process_vertices(adjacency.degrees(derive.sparse(s, d)), F.col("degree"), active)


def _one_hop(s: SparkSession, d: str, g: Graph) -> DataFrame:
    return adjacency.neighbors(g, ROOT).distinct().select(F.col("neighbor").alias("id"))


def _ids(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.col("id").alias("v"))


def _delta(s: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank_delta(derive.sparse(s, d), 3).select("iter", F.round(F.col("delta") + NUDGE, 6).alias("delta"))


def _sssp_grown(s: SparkSession, d: str) -> DataFrame:
    """From the distances before the batch."""
    return frontier.sssp_after_insert(_grown(s, d), frontier.sssp(derive.sparse(s, d), ROOT), _batch(s, d))


def _batch(s: SparkSession, d: str) -> DataFrame:
    """What ``_grown`` inserts."""
    return derive.co_order_edges(s, d).where(F.col("weight") >= 45).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _bfs_grown(s: SparkSession, d: str) -> DataFrame:
    return frontier.bfs_after_insert(_grown(s, d), frontier.bfs(derive.sparse(s, d), ROOT), _batch(s, d))


def _weak_grown(s: SparkSession, d: str) -> DataFrame:
    return components.components_after_insert(_grown(s, d), components.weak_components(derive.sparse(s, d)), _batch(s, d))


def _many_hops(s: SparkSession, d: str) -> DataFrame:
    """Two steps from every twentieth vertex."""
    return adjacency.k_hop(derive.co_order(s, d), derive.parts(s, d).where("id % 20 = 0"), 2)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return derive.parts(s, d).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


def _split(s: SparkSession, d: str) -> DataFrame:
    first, rest = updates.split_edges(derive.sparse(s, d).edges, SPLIT)
    return first.groupBy().agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).withColumn("part", F.lit("first")).unionByName(
        rest.groupBy().agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).withColumn("part", F.lit("rest"))
    )


def _deleted(s: SparkSession, d: str) -> DataFrame:
    g = derive.co_order(s, d)
    return updates.delete_edges(g, derive.sparse(s, d).edges).edges


def _trials(s: SparkSession, d: str) -> DataFrame:
    """What the timed insertions leave; the times themselves differ from run to run."""
    return updates.insert_trials(derive.sparse(s, d), 500, 3)[1].select("trial", "edges")


def _inserted_trials(s: SparkSession, d: str) -> DataFrame:
    g, _ = updates.insert_trials(derive.sparse(s, d), 500, 3)
    return g.edges


def _inserted_lines(s: SparkSession, d: str) -> DataFrame:
    """A hundred lines of a sorted text of the edges, inserted once more."""
    path, g = scratch(s, "edges-text"), derive.sparse(s, d)
    edge_text.write_text(g.edges.sort("src", "dst", "weight").coalesce(1), path)
    return updates.insert_lines(g, path, SPLIT, 2 * SPLIT).edges.select("src", "dst")


def _text_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "edges-text")
    edge_text.write_text(derive.sparse(s, d).edges, path)
    return edge_text.read_weighted(s, path)


def _binary_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "edges-binary")
    edge_binary.write_binary(derive.sparse(s, d).edges, path)
    return edge_binary.read_triples(s, path)


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Edges in four files that arrive one by one."""
    source, table = scratch(s, "stream-source"), scratch(s, "stream-table")
    derive.sparse(s, d).edges.repartition(4).write.parquet(source)
    ingest.stream_insert(ingest.edge_stream(s, source, 1), table, scratch(s, "stream-state")).awaitTermination()
    return ingest.snapshot(s, table)


def _streamed_distances(s: SparkSession, d: str) -> DataFrame:
    """Distances after the last of three batches."""
    source, table, results = scratch(s, "stream-source"), scratch(s, "stream-table"), scratch(s, "stream-results")
    g = derive.sparse(s, d)
    g.edges.repartition(3).write.parquet(source)
    ingest.stream_distances(ingest.edge_stream(s, source, 1), table, results, scratch(s, "stream-state"), g.vertices, ROOT).awaitTermination()
    found = s.read.schema("id long, distance long, batch_id int").parquet(results)
    last = found.agg(F.max("batch_id").alias("last"))
    return found.join(F.broadcast(last), F.col("batch_id") == F.col("last")).select("id", "distance")


def _subset(s: SparkSession, d: str) -> DataFrame:
    """Messages of every third vertex only."""
    g = derive.co_order(s, d)
    chosen = messages.VertexSet(g.vertices.where("id % 3 = 0")).without_ids(g.vertices.where("id % 5 = 0"))
    return messages.aggregate_messages(g, _ids(g), F.col("v") + F.col("weight"), F.min, active=chosen.ids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    co, sparse = derive.co_order, derive.sparse
    return {
        "edges_co_order": lambda s, d: derive.co_order_edges(s, d),
        "edges_symmetric": lambda s, d: co(s, d).symmetric().edges.select("src", "dst"),
        "edges_simple": lambda s, d: co(s, d).simple(),
        "edges_endpoints": lambda s, d: endpoints(sparse(s, d).edges),
        "out_degree": lambda s, d: adjacency.degrees(sparse(s, d), "out"),
        "in_degree": lambda s, d: adjacency.degrees(sparse(s, d), "in"),
        "degree_stats": lambda s, d: profile.degree_stats(co(s, d)),
        "degree_stats_sparse": lambda s, d: profile.degree_stats(sparse(s, d)),
        "hub_histogram": lambda s, d: profile.hub_histogram(co(s, d)),
        "hub_vertices": lambda s, d: profile.hub_vertices(co(s, d)),
        "neighbors_out": lambda s, d: adjacency.neighbors(co(s, d), ROOT),
        "neighbors_in": lambda s, d: adjacency.neighbors(co(s, d), ROOT, "in"),
        "edge_exists": lambda s, d: adjacency.edges_exist(co(s, d), _asked(s, d)),
        "k_hop_1": lambda s, d: adjacency.k_hop(co(s, d), _source(s), 1),
        "k_hop_2": lambda s, d: adjacency.k_hop(co(s, d), _source(s), 2),
        "k_hop_2_distinct": lambda s, d: adjacency.k_hop(co(s, d), _source(s), 2, distinct=True),
        "vertex_remap": lambda s, d: profile.vertex_remap(sparse(s, d).edges),
        "batch_insert": lambda s, d: _grown(s, d).edges,
        "batch_insert_degree": lambda s, d: adjacency.degrees(_grown(s, d)),
        "pagerank": lambda s, d: _ranked(pagerank.pagerank(co(s, d), ITERATIONS)),
        "pagerank_dangling": lambda s, d: _ranked(pagerank.pagerank(sparse(s, d), ITERATIONS)),
        "pagerank_bipartite": lambda s, d: _ranked(pagerank.pagerank(derive.bipartite(s, d), ITERATIONS)),
        "pagerank_after_insert": lambda s, d: _ranked(pagerank.pagerank(_grown(s, d), ITERATIONS)),
        "pagerank_in_degree": lambda s, d: _ranked(pagerank.pagerank(co(s, d), ITERATIONS, by="in")),
        "pagerank_delta": _delta,
        "sssp": lambda s, d: frontier.sssp(co(s, d), ROOT),
        "sssp_sparse": lambda s, d: frontier.sssp(sparse(s, d), ROOT),
        "sssp_after_insert": _sssp_grown,
        "bfs": lambda s, d: frontier.bfs(co(s, d), ROOT),
        "bfs_sparse": lambda s, d: frontier.bfs(sparse(s, d), ROOT),
        "cc_directed": lambda s, d: frontier.directed_labels(sparse(s, d)),
        "cc_weak": lambda s, d: components.weak_components(sparse(s, d)),
        "cc_sizes": lambda s, d: components.component_sizes(frontier.directed_labels(sparse(s, d))),
        "cc_count": lambda s, d: components.component_count(frontier.directed_labels(sparse(s, d))),
        "label_propagation": lambda s, d: label_propagation.label_propagation(sparse(s, d), 2),
        "label_propagation_in": lambda s, d: label_propagation.label_propagation(sparse(s, d), 2, "in"),
        "triangle_count": lambda s, d: triangles.triangle_count(co(s, d)),
        "triangle_count_directed": lambda s, d: triangles.directed_triangle_count(co(s, d)),
        "triangles_per_vertex": lambda s, d: triangles.triangles_per_vertex(co(s, d)),
        "process_vertices_sum": _active_degree,
        "active_edges": lambda s, d: adjacency.active_edges(co(s, d), _one_hop(s, d, co(s, d))),
        "direction_choice": lambda s, d: adjacency.active_edges(sparse(s, d), sparse(s, d).vertices.where("id % 2 = 0")),
        "degree_sum_all": lambda s, d: messages.process_vertices(adjacency.degrees(sparse(s, d)), F.col("degree")),
        "edges_unit_weight": lambda s, d: updates.unit_weights(sparse(s, d).edges),
        "hub_ratio": lambda s, d: profile.hub_ratio(co(s, d)),
        "neighbor_lists": lambda s, d: adjacency.neighbor_lists(sparse(s, d)).select("id", F.array_join("neighbors", ",").alias("neighbors")),
        "common_neighbors": lambda s, d: adjacency.common_neighbors(co(s, d), _pairs(s, d)),
        "k_hop_2_many": _many_hops,
        "split_edges": _split,
        "delete_edges": _deleted,
        "insert_lines": _inserted_lines,
        "k_hop_2_random": lambda s, d: adjacency.k_hop(co(s, d), adjacency.random_sources(co(s, d)), 2),
        "aggregate_messages_sub": lambda s, d: messages.aggregate_messages(co(s, d), _ids(co(s, d)), F.col("weight"), lambda m: F.negative(F.sum(m))),
        "insert_trials": _trials,
        "insert_trials_edges": _inserted_trials,
        "pagerank_tol": lambda s, d: _ranked(pagerank.pagerank(co(s, d), 30, tol=TOL)),
        "bfs_after_insert": _bfs_grown,
        "cc_weak_after_insert": _weak_grown,
        "aggregate_messages_subset": _subset,
        "rmat_edges": lambda s, d: rmat.rmat_edges(s, 5_000, 1 << 10, seed=7),
        "random_edge_query": lambda s, d: adjacency.edges_exist(co(s, d), rmat.query_edges(s, parts_n(s, d), 10_000)),
        "text_round_trip": _text_trip,
        "binary_round_trip": _binary_trip,
        "stream_insert": _streamed,
        "stream_distances": _streamed_distances,
        "aggregate_messages_min": lambda s, d: messages.aggregate_messages(co(s, d), _ids(co(s, d)), F.col("v") + F.col("weight"), F.min),
        "aggregate_messages_sum": lambda s, d: messages.aggregate_messages(co(s, d), _ids(co(s, d)), F.col("v") * F.col("weight"), F.sum, to="src"),
    }


_CO = (
    "SELECT a.l_partkey::BIGINT src, b.l_partkey::BIGINT dst, CAST(least(a.l_quantity, b.l_quantity) AS BIGINT) weight "
    "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"
)
_GRAPHS = f"co AS MATERIALIZED ({_CO}), sp AS MATERIALIZED (SELECT * FROM co WHERE weight >= {SPARSE}), v AS (SELECT p_partkey::BIGINT id FROM part)"
_GROWN = "gr AS MATERIALIZED (SELECT * FROM sp UNION ALL SELECT dst, src, 0::BIGINT FROM co WHERE weight >= 45)"


def _with(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((_GRAPHS, *ctes))} {last}"


def _pagerank_sql(edges: str, vertices: str = "v", by: str = "src", ctes: tuple[str, ...] = (), iterations: int = ITERATIONS) -> str:
    deg = f"dg AS MATERIALIZED (SELECT {by} id, count(*) n FROM {edges} GROUP BY 1)"
    sh = f"sh AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / dg.n share FROM {edges} JOIN dg ON dg.id = src)"
    steps = [f"r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM {vertices})"]
    for i in range(iterations):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT x.id, 0.15 + 0.85 * coalesce(y.s, 0) AS rank FROM {vertices} x LEFT JOIN "
            f"(SELECT dst, sum(rank * share) s FROM sh JOIN r{i} ON r{i}.id = src GROUP BY 1) y ON y.dst = x.id)"
        )
    return _with(*ctes, deg, sh, *steps, f"SELECT id, round(rank::DOUBLE + {NUDGE}, 6) AS rank FROM r{iterations}")


def _pagerank_tol_sql(most: int = 12) -> str:
    """The ranks of the first iteration whose delta is small enough."""
    body = _pagerank_sql("co", iterations=most).rpartition("SELECT id, round")[0]
    delta = lambda i: f"SELECT {i} AS i, (SELECT sum(abs(a.rank - b.rank) * coalesce(dg.n, 0)) FROM r{i} a JOIN r{i - 1} b USING (id) LEFT JOIN dg USING (id)) / (SELECT count(*) FROM v) AS delta"
    deltas = " UNION ALL ".join(delta(i) for i in range(1, most + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, id, rank FROM r{i}" for i in range(1, most + 1))
    return f"{body.rstrip()}, dl AS ({deltas}), ev AS ({every}) SELECT id, round(rank + {NUDGE}, 6) AS rank FROM ev WHERE i = (SELECT min(i) FROM dl WHERE delta <= {TOL})"


def _delta_sql() -> str:
    body = _pagerank_sql("sp", iterations=3).rpartition("SELECT id, round")[0]
    one = lambda i: (
        f"SELECT {i}::INTEGER AS iter, round((SELECT sum(abs(a.rank - b.rank) * coalesce(dg.n, 0)) FROM r{i} a JOIN r{i - 1} b USING (id) LEFT JOIN dg USING (id)) / (SELECT count(*) FROM v) + {NUDGE}, 6)::DOUBLE AS delta"
    )
    return body + " UNION ALL ".join(one(i) for i in (1, 2, 3))


def _sssp_sql(edges: str, ctes: tuple[str, ...] = ()) -> str:
    walk = (
        f"t(id, x) USING KEY (id) AS (SELECT {ROOT}::BIGINT, 0::BIGINT UNION SELECT e.dst, min(t.x + e.weight)::BIGINT FROM t JOIN {edges} e ON e.src = t.id "
        "LEFT JOIN recurring.t o ON o.id = e.dst WHERE o.x IS NULL OR t.x + e.weight < o.x GROUP BY 1)"
    )
    return _with(*ctes, walk, "SELECT v.id, t.x AS distance FROM v LEFT JOIN t ON t.id = v.id", recursive=True)


def _bfs_sql(edges: str, ctes: tuple[str, ...] = ()) -> str:
    walk = (
        f"t(id, x) USING KEY (id) AS (SELECT {ROOT}::BIGINT, 0::INTEGER UNION SELECT DISTINCT e.dst, t.x + 1 FROM t JOIN {edges} e ON e.src = t.id "
        "LEFT JOIN recurring.t o ON o.id = e.dst WHERE o.x IS NULL)"
    )
    up = f"p AS (SELECT e.dst id, min(e.src) parent FROM {edges} e JOIN t a ON a.id = e.src JOIN t b ON b.id = e.dst AND b.x = a.x + 1 GROUP BY 1)"
    last = f"SELECT v.id, t.x AS depth, CASE WHEN v.id = {ROOT} THEN v.id ELSE p.parent END AS parent FROM v LEFT JOIN t ON t.id = v.id LEFT JOIN p ON p.id = v.id"
    return _with(*ctes, walk, up, last, recursive=True)


def _cc_sql(edges: str, last: str, ctes: tuple[str, ...] = ()) -> str:
    walk = (
        f"t(id, x) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(t.x) FROM t JOIN ({edges}) e ON e.src = t.id "
        "JOIN recurring.t o ON o.id = e.dst WHERE t.x < o.x GROUP BY 1)"
    )
    return _with(*ctes, walk, last, recursive=True)


def _lp_sql(voter: str, teller: str, rounds: int = 2) -> str:
    steps = ["l0 AS (SELECT id, (id % 15 + 1)::INTEGER AS label FROM v)"]
    for i in range(rounds):
        best = f"SELECT e.{voter} id, l.label, count(*) n FROM sp e JOIN l{i} l ON l.id = e.{teller} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY e.{voter} ORDER BY count(*) DESC, l.label) = 1"
        steps.append(f"l{i + 1} AS (SELECT v.id, (CASE WHEN v.id = 0 THEN 1 ELSE coalesce(b.label, 1) END)::INTEGER AS label FROM v LEFT JOIN ({best}) b ON b.id = v.id)")
    return _with(*steps, f"SELECT id, label FROM l{rounds}")


def _degree_sql(edges: str, key: str, ctes: tuple[str, ...] = ()) -> str:
    return _with(*ctes, f"SELECT v.id, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT {key} id, count(*) n FROM {edges} GROUP BY 1) d ON d.id = v.id")


def _stats_sql(edges: str) -> str:
    ends = f"ep AS (SELECT src id FROM {edges} UNION SELECT dst FROM {edges})"
    deg = f"dd AS (SELECT ep.id, count(e.src) degree FROM ep LEFT JOIN {edges} e ON e.src = ep.id GROUP BY 1)"
    num = "nn AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k FROM dd)"
    last = (
        "SELECT count(*) AS v, sum(degree)::BIGINT AS e, sum(degree) / count(*) AS avg_degree, "
        "(SELECT degree FROM nn WHERE k = (SELECT count(*) FROM dd) // 2) AS median_degree, "
        "CASE WHEN count(*) % 2 = 1 THEN (SELECT degree FROM nn WHERE k = (SELECT count(*) FROM dd) // 2 - 1) END AS lower_median_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM dd"
    )
    return _with(ends, deg, num, last)


_SIMPLE = "si AS MATERIALIZED (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM co)"
_TRIANGLES = "tr AS (SELECT x.a p, x.b q, y.b r FROM si x JOIN si y ON y.a = x.b JOIN si z ON z.a = x.a AND z.b = y.b)"
_BIP = (
    "bp AS MATERIALIZED (SELECT o_custkey::BIGINT src, (l_suppkey + (SELECT count(*) FROM customer))::BIGINT dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), "
    "bv AS (SELECT unnest(range((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)))::BIGINT id)"
)


def oracle_sql() -> dict[str, str]:
    weak = "SELECT src, dst FROM sp UNION SELECT dst, src FROM sp"
    directed = "SELECT DISTINCT src, dst FROM sp"
    hop = f"SELECT b.dst AS vertex FROM co a JOIN co b ON b.src = a.dst WHERE a.src = {ROOT}"
    return {
        "edges_co_order": _with("SELECT src, dst, weight FROM co"),
        "edges_symmetric": _with("SELECT src, dst FROM co UNION SELECT dst, src FROM co"),
        "edges_simple": _with("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM co"),
        "edges_endpoints": _with("SELECT src AS id FROM sp UNION SELECT dst FROM sp"),
        "out_degree": _degree_sql("sp", "src"),
        "in_degree": _degree_sql("sp", "dst"),
        "degree_stats": _stats_sql("co"),
        "degree_stats_sparse": _stats_sql("sp"),
        "hub_histogram": _with("SELECT CASE WHEN coalesce(n, 0) > 14 THEN 'hub' ELSE 'other' END AS bucket, count(*) AS n FROM v LEFT JOIN (SELECT src, count(*) n FROM co GROUP BY 1) d ON d.src = v.id GROUP BY 1"),
        "hub_vertices": _with("SELECT src AS id FROM co GROUP BY 1 HAVING count(*) > 14"),
        "neighbors_out": _with(f"SELECT dst AS neighbor FROM co WHERE src = {ROOT}"),
        "neighbors_in": _with(f"SELECT src AS neighbor FROM co WHERE dst = {ROOT}"),
        "edge_exists": _with(f"SELECT src, dst, EXISTS (SELECT 1 FROM co WHERE co.src = q.src AND co.dst = q.dst) AS found FROM (SELECT id src, id + {OFFSET} dst FROM v UNION ALL SELECT src, dst FROM sp) q"),
        "k_hop_1": _with(f"SELECT dst AS vertex FROM co WHERE src = {ROOT}"),
        "k_hop_2": _with(hop),
        "k_hop_2_distinct": _with(hop.replace("SELECT b.dst", "SELECT DISTINCT b.dst")),
        "vertex_remap": _with(
            "m AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT k FROM (SELECT src id FROM sp UNION SELECT dst FROM sp))",
            "SELECT a.k AS src, b.k AS dst, weight FROM sp JOIN m a ON a.id = src JOIN m b ON b.id = dst",
        ),
        "batch_insert": _with(_GROWN, "SELECT src, dst, weight FROM gr"),
        "batch_insert_degree": _degree_sql("gr", "src", (_GROWN,)),
        "pagerank": _pagerank_sql("co"),
        "pagerank_dangling": _pagerank_sql("sp"),
        "pagerank_bipartite": _pagerank_sql("bp", "bv", ctes=(_BIP,)),
        "pagerank_after_insert": _pagerank_sql("gr", ctes=(_GROWN,)),
        "pagerank_in_degree": _pagerank_sql("co", by="dst"),
        "pagerank_delta": _delta_sql(),
        "sssp": _sssp_sql("co"),
        "sssp_sparse": _sssp_sql("sp"),
        "sssp_after_insert": _sssp_sql("gr", (_GROWN,)),
        "bfs": _bfs_sql("co"),
        "bfs_sparse": _bfs_sql("sp"),
        "cc_directed": _cc_sql(directed, "SELECT id, x AS label FROM t"),
        "cc_weak": _cc_sql(weak, "SELECT id, x AS label FROM t"),
        "cc_sizes": _cc_sql(directed, "SELECT x AS label, count(*) AS n FROM t GROUP BY 1"),
        "cc_count": _cc_sql(directed, "SELECT count(DISTINCT x) AS components FROM t"),
        "label_propagation": _lp_sql("src", "dst"),
        "label_propagation_in": _lp_sql("dst", "src"),
        "triangle_count": _with(_SIMPLE, _TRIANGLES, "SELECT count(*) AS triangles FROM tr"),
        "triangle_count_directed": _with(
            "de AS (SELECT DISTINCT src, dst FROM co)",
            "SELECT count(*) AS triangles FROM de x JOIN de y ON y.src = x.src JOIN de z ON z.src = x.dst AND z.dst = y.dst WHERE y.dst < x.src AND x.src < x.dst",
        ),
        "triangles_per_vertex": _with(
            _SIMPLE, _TRIANGLES,
            "SELECT v.id, coalesce(n, 0)::BIGINT AS n FROM v LEFT JOIN (SELECT id, count(*) n FROM (SELECT unnest([p, q, r]) id FROM tr) GROUP BY 1) c ON c.id = v.id",
        ),
        "process_vertices_sum": _with("SELECT count(*) AS total FROM sp WHERE src % 3 = 0"),
        "degree_sum_all": _with("SELECT count(*) AS total FROM sp"),
        "edges_unit_weight": _with("SELECT src, dst, 1::BIGINT AS weight FROM sp"),
        "hub_ratio": _with(
            "h AS (SELECT count(*) FILTER (n > 14) k, count(*) a FROM (SELECT v.id, count(co.src) n FROM v LEFT JOIN co ON co.src = v.id GROUP BY 1))",
            "SELECT k AS hubs, a - k AS others, k / a AS ratio FROM h",
        ),
        "neighbor_lists": _with("SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM sp GROUP BY 1"),
        "common_neighbors": _with(
            "n AS (SELECT DISTINCT src, dst FROM co)",
            "SELECT v.id AS a, v.id + 1 AS b, (SELECT count(*) FROM n x JOIN n y ON x.dst = y.dst WHERE x.src = v.id AND y.src = v.id + 1) AS common FROM v",
        ),
        "k_hop_2_many": _with("SELECT b.dst AS vertex FROM co a JOIN co b ON b.src = a.dst WHERE a.src % 20 = 0"),
        "split_edges": _with(
            "p AS (SELECT weight, row_number() OVER (ORDER BY src, dst, weight) k FROM sp)",
            f"SELECT CASE WHEN k <= {SPLIT} THEN 'first' ELSE 'rest' END AS part, count(*) AS n, sum(weight)::BIGINT AS weight FROM p GROUP BY 1",
        ),
        "delete_edges": _with("SELECT src, dst, weight FROM co WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.src = co.src AND sp.dst = co.dst)"),
        "insert_trials": _with("SELECT k::INTEGER AS trial, (SELECT count(*) FROM sp) + 500 * (k + 1) AS edges FROM range(3) r(k)"),
        "insert_lines": _with(
            "p AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst, weight) - 1 AS k FROM sp)",
            f"SELECT src, dst FROM sp UNION ALL SELECT src, dst FROM p WHERE k >= {SPLIT} AND k < {2 * SPLIT}",
        ),
        "aggregate_messages_sub": _with("SELECT dst AS id, -sum(weight)::BIGINT AS value FROM co GROUP BY 1"),
        "pagerank_tol": _pagerank_tol_sql(),
        "bfs_after_insert": _bfs_sql("gr", (_GROWN,)),
        "cc_weak_after_insert": _cc_sql("SELECT src, dst FROM gr UNION SELECT dst, src FROM gr", "SELECT id, x AS label FROM t", (_GROWN,)),
        "aggregate_messages_subset": _with("SELECT dst AS id, min(src + weight)::BIGINT AS value FROM co WHERE src % 3 = 0 AND src % 5 <> 0 GROUP BY 1"),
        "text_round_trip": _with("SELECT src, dst, weight FROM sp"),
        "binary_round_trip": _with("SELECT src, dst, weight FROM sp"),
        "stream_insert": _with("SELECT src, dst, weight FROM sp"),
        "stream_distances": _sssp_sql("sp"),
        "active_edges": _with(f"SELECT count(*) AS active_edges, count(*) * 20 < (SELECT count(*) FROM co) AS sparse FROM co WHERE src IN (SELECT dst FROM co WHERE src = {ROOT})"),
        "direction_choice": _with("SELECT count(*) AS active_edges, count(*) * 20 < (SELECT count(*) FROM sp) AS sparse FROM sp WHERE src % 2 = 0"),
        "aggregate_messages_min": _with("SELECT dst AS id, min(src + weight)::BIGINT AS value FROM co GROUP BY 1"),
        "aggregate_messages_sum": _with("SELECT src AS id, sum(dst * weight)::BIGINT AS value FROM co GROUP BY 1"),
    }
