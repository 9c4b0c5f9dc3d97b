import math
import struct

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import adjacency, messages, profile, updates
from loomgraph.plans import components, frontier, label_propagation, pagerank, triangles
from loomgraph.sources import edge_binary, edge_text, info, rmat
from loomgraph.streaming import ingest

TINY = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (2, 3, 8), (3, 0, 7), (3, 0, 7), (4, 4, 3), (4, 5, 2), (5, 6, 1), (6, 4, 9), (8, 5, 6)]
SAMPLE = [(0, 1, 300), (1, 2, 100), (3, 4, 50)]
SCHEMA = "src long, dst long, weight long"


@pytest.fixture(scope="module")
def tiny(spark):
    return Graph.dense(spark, 9, spark.createDataFrame(TINY, SCHEMA))


@pytest.fixture(scope="module")
def sample(spark):
    return Graph.dense(spark, 5, spark.createDataFrame(SAMPLE, SCHEMA))


def by_id(df, *cols):
    rows = sorted(tuple(r) for r in df.select("id", *cols).collect())
    return [r[1] if len(cols) == 1 else r[1:] for r in rows]


def test_pagerank_known(tiny, sample):
    assert [round(x, 6) for x in by_id(pagerank.pagerank(tiny), "rank")] == [1.170365, 0.94481, 0.664401, 1.220424, 1.788176, 1.037393, 1.02443, 0.15, 0.15]
    assert [round(x, 6) for x in by_id(pagerank.pagerank(sample), "rank")] == [0.15, 0.2775, 0.385875, 0.15, 0.2775]


def test_pagerank_keeps_mass_without_dangling_vertices(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 7, 1) for i in range(7)] + [(0, 3, 1)], SCHEMA)
    assert math.isclose(sum(by_id(pagerank.pagerank(Graph.of(ring), 6), "rank")), 7, rel_tol=1e-9)


def test_degree_choice_differs_on_asymmetric_graphs(tiny):
    assert by_id(pagerank.pagerank(tiny, 3), "rank") != by_id(pagerank.pagerank(tiny, 3, by="in"), "rank")


def test_shortest_paths(tiny):
    assert by_id(frontier.sssp(tiny, 0), "distance") == [0, 3, 1, 8, None, None, None, None, None]
    assert by_id(frontier.sssp(tiny, 0, sentinel=10**9), "distance")[4] == 10**9
    d = frontier.sssp(tiny, 0)
    wrong = tiny.edges.join(d.withColumnsRenamed({"id": "src", "distance": "a"}), "src").join(d.withColumnsRenamed({"id": "dst", "distance": "b"}), "dst")
    assert wrong.where("a IS NOT NULL AND (b IS NULL OR b > a + weight)").isEmpty()


def test_shortest_paths_after_insert(spark, tiny):
    batch = spark.createDataFrame([(3, 4, 2), (0, 3, 1)], SCHEMA)
    grown = updates.insert_edges(tiny, batch)
    again = frontier.sssp_after_insert(grown, frontier.sssp(tiny, 0), batch)
    assert by_id(again, "distance") == by_id(frontier.sssp(grown, 0), "distance") == [0, 3, 1, 1, 3, 5, 6, None, None]


def test_bfs(tiny):
    got = by_id(frontier.bfs(tiny, 0), "depth", "parent")
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1)] + [(None, None)] * 5


def test_components(tiny):
    assert by_id(frontier.directed_labels(tiny), "label") == [0, 0, 0, 0, 4, 4, 4, 7, 8]
    weak = components.weak_components(tiny)
    assert by_id(weak, "label") == [0, 0, 0, 0, 4, 4, 4, 7, 4]
    assert components.component_count(weak).first()[0] == 3


def test_long_path_contracts(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 103)], "a long, b long")
    got = {r.id: r.label for r in components.component_labels(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 103}


def test_label_propagation(tiny):
    assert by_id(label_propagation.label_propagation(tiny, 1), "label") == [1, 4, 2, 1, 5, 7, 5, 1, 6]
    assert by_id(label_propagation.label_propagation(tiny, 2), "label") == [1, 1, 1, 1, 5, 5, 5, 1, 7]


def test_triangles_do_not_depend_on_names(spark, tiny):
    brute = {frozenset((a, b, c)) for a, b, _ in TINY for c in range(9) if len({a, b, c}) == 3 and all({x, y} in [{s, d} for s, d, _ in TINY] for x, y in ((a, c), (b, c)))}
    assert triangles.triangle_count(tiny).first()[0] == len(brute)
    renamed = Graph.of(spark.createDataFrame([(50 - 3 * a, 50 - 3 * b, w) for a, b, w in TINY], SCHEMA))
    assert triangles.triangle_count(renamed).first()[0] == len(brute)
    assert sum(by_id(triangles.triangles_per_vertex(tiny), "n")) == 3 * len(brute)


def test_degrees_neighbours_and_hops(spark, tiny):
    assert by_id(adjacency.degrees(tiny), "degree") == [2, 1, 2, 2, 2, 1, 1, 0, 1]
    assert sorted(r[0] for r in adjacency.neighbors(tiny, 3).collect()) == [0, 0]
    assert {r.id: r.neighbors for r in adjacency.neighbor_lists(tiny).collect()}[3] == [0, 0]
    assert sorted(r[0] for r in adjacency.k_hop(tiny, spark.range(3, 4), 2).collect()) == [1, 1, 2, 2]
    assert sorted(r[0] for r in adjacency.k_hop(tiny, spark.range(3, 4), 2, distinct=True).collect()) == [1, 2]
    none = spark.range(7, 8)
    assert adjacency.k_hop(tiny, none, 2).isEmpty()


def test_edge_queries_after_insert(spark, tiny):
    grown = updates.insert_edge(tiny, 7, 20)
    asked = spark.createDataFrame([(7, 20), (20, 7), (7, 20), (None, 1)], "src long, dst long")
    got = sorted((r.src, r.found) for r in adjacency.edges_exist(grown, asked).collect() if r.src)
    assert got == [(7, True), (7, True), (20, False)]
    assert grown.unknown_endpoints().isEmpty()
    assert grown.edges.count() == len(TINY) + 1


def test_profile(spark, tiny):
    assert tuple(profile.degree_stats(tiny).first()) == (8, 12, 1.5, 2, None, 2, 1)
    odd = Graph.of(spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 4, 1), (1, 2, 1), (2, 0, 1)], SCHEMA))
    assert tuple(profile.degree_stats(odd).first()) == (5, 6, 1.2, 1, 0, 3, 0)
    assert tuple(profile.degree_stats(Graph.dense(spark, 3, spark.createDataFrame([], SCHEMA))).first()) == (0, 0, None, None, None, None, None)
    assert tuple(profile.hub_ratio(tiny, 1).first()) == (4, 5, 4 / 9)
    derived = profile.vertex_remap(tiny.edges, unweighted=True, seed=3)
    assert derived.where("weight BETWEEN 1 AND 10000").count() == len(TINY) and derived.agg(F.max("src")).first()[0] == 7
    assert {r.id: r.new_id for r in profile.dense_ids(tiny.edges).collect()} == {**{i: i for i in range(7)}, 8: 7}
    assert profile.vertex_remap(tiny.edges).count() == len(TINY)
    assert profile.hub_vertices(tiny, 1).count() == 4


def test_split_and_delete(spark, tiny):
    first, rest = updates.split_edges(tiny.edges, 5)
    assert first.count() == 5
    assert sorted(map(tuple, first.union(rest).collect())) == sorted(TINY)
    assert updates.delete_edges(tiny, spark.createDataFrame([(3, 0)], "src long, dst long")).edges.count() == len(TINY) - 2


def test_pregel_matches_the_plan(tiny):
    got = messages.pregel(tiny, tiny.vertices.withColumn("low", F.col("id")), F.col("low"), F.min, lambda m: {"low": F.least(F.col("low"), F.coalesce(m, F.col("low")))}, 9)
    assert by_id(got, "low") == by_id(frontier.directed_labels(tiny), "label")


def test_text_round_trip(spark, tiny, tmp_path):
    edge_text.write_text(tiny.edges, str(tmp_path / "t"))
    assert sorted(map(tuple, edge_text.read_weighted(spark, str(tmp_path / "t")).collect())) == sorted(TINY)
    (tmp_path / "c.txt").write_text("# a comment\n1 2\n\n 3\t4 \n#x\n5  6\n")
    pairs = edge_text.read_unweighted(spark, str(tmp_path / "c.txt")).collect()
    assert [(r.src, r.dst) for r in pairs] == [(1, 2), (3, 4), (5, 6)]
    assert all(1 <= r.weight <= 10_000 for r in pairs)
    assert [(r.src, r.dst) for r in edge_text.read_lines(spark, str(tmp_path / "c.txt"), 1, 3).collect()] == [(3, 4)]
    (tmp_path / "h.tsv").write_text("title\nsym 2 9 9\n1 2\n3 4\n")
    figures, rows = edge_text.read_headed_pairs(spark, str(tmp_path / "h.tsv"))
    assert figures["edges"] == 2 and rows.count() == 2


def test_binary_round_trip_and_info(spark, tiny, tmp_path):
    assert edge_binary.write_binary(tiny.edges, str(tmp_path / "b")) >= 1
    assert sorted(map(tuple, edge_binary.read_triples(spark, str(tmp_path / "b")).collect())) == sorted(TINY)
    edge_binary.write_binary(tiny.edges, str(tmp_path / "p"), weighted=False)
    assert sorted((r.src, r.dst) for r in edge_binary.read_pairs(spark, str(tmp_path / "p")).collect()) == sorted(x[:2] for x in TINY)
    (tmp_path / "one.bin").write_bytes(struct.pack("<3i", 7, 8, 9))
    (tmp_path / "g.info").write_text(f"9 12\n{tmp_path}/b\n1\n")
    g = info.load_graph(spark, str(tmp_path / "g.info"))
    assert (g.vertices.count(), g.edges.count()) == (9, 12)
    (tmp_path / "o.info").write_text("9 12\n")
    assert info.read_info(spark, str(tmp_path / "o.info")).path is None


def test_binary_keeps_what_is_there(spark, tiny, tmp_path):
    """Negative numbers, several files, and a folder with files of someone else's."""
    rows = [(2**31 - 1, -(2**31), -1), (0, 1, -7)] + [(k, k + 1, 2 * k) for k in range(500)]
    many = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert edge_binary.write_binary(many, f"file://{tmp_path}/many") == 5
    assert sorted(map(tuple, edge_binary.read_triples(spark, str(tmp_path / "many")).collect())) == sorted(rows)
    assert all(len(p.read_bytes()) % 12 == 0 for p in (tmp_path / "many").iterdir() if not p.name.startswith("."))
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "notes.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        edge_binary.write_binary(tiny.edges, str(tmp_path / "own"))
    assert [p.name for p in (tmp_path / "own").iterdir()] == ["notes.txt"]
    plan = edge_binary.read_triples(spark, str(tmp_path / "many"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_converters(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n1 2 3\n4 5 6\n")
    (tmp_path / "h.tsv").write_text("1 2\nsym 2 9 9\n1 2\n3 4\n")  # the header looks like an edge
    read = lambda name, f: sorted(map(tuple, f(spark, str(tmp_path / name)).select("src", "dst").collect()))
    for kind in ("weighted", "unweighted", "derived"):
        edge_binary.convert_text(spark, str(tmp_path / "t.txt"), str(tmp_path / kind), kind)
    edge_binary.convert_text(spark, str(tmp_path / "h.tsv"), str(tmp_path / "headed"), "headed")
    assert read("weighted", edge_binary.read_triples) == read("unweighted", edge_binary.read_pairs) == read("derived", edge_binary.read_triples) == [(1, 2), (4, 5)]
    assert [r.weight for r in edge_binary.read_triples(spark, str(tmp_path / "weighted")).orderBy("src").collect()] == [3, 6]
    assert read("headed", edge_binary.read_pairs) == [(1, 2), (3, 4)]
    (tmp_path / "g.info").write_text(f"6 2\n{tmp_path}/weighted\n1\n")
    g = info.load_graph(spark, str(tmp_path / "g.info"), mode="both", unit=True)
    assert g.stores("both") and {r.weight for r in g.by("dst").collect()} == {1}
    g.release()
    assert not g.stores("out")
    lines = spark.read.text(str(tmp_path / "t.txt"))
    assert edge_text.preview(lines, 1) == {"head": ["# c"], "tail": ["4 5 6"], "count": 3}
    assert edge_text.first_edges(edge_text.read_weighted(spark, str(tmp_path / "t.txt")), 1) in ([(1, 2, 3)], [(4, 5, 6)])


def test_line_ranges_of_a_split_file(spark, tmp_path):
    text = "".join(f"{k} {k + 1}\n" + "# comment\n" * (k % 3 == 0) for k in range(400))
    (tmp_path / "e.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        assert spark.read.text(str(tmp_path / "e.txt")).rdd.getNumPartitions() > 3
        got = edge_text.read_lines(spark, str(tmp_path / "e.txt"), 7, 203).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.src for r in got) == list(range(7, 203))


def test_rmat_query_list_and_legacy_scale(spark):
    asked = rmat.query_edges(spark, 100, 1000).collect()
    assert len(asked) == 50 and all(r.src < 64 and r.dst < 64 for r in asked)
    low = rmat.rmat_edges(spark, 4000, 64, legacy_scale=True).where("src < 32 AND dst < 32").count() / 4000
    assert 0.2 < low < 0.3


def test_insert_trials_accumulate(spark, tiny):
    grown, told = updates.insert_trials(tiny, 50, 3, seed=5)
    rows = told.orderBy("trial").collect()
    assert [(r.trial, r.edges) for r in rows] == [(0, 62), (1, 112), (2, 162)] and all(r.edges_per_second > 0 for r in rows)
    assert grown.edges.count() == 162 and grown.unknown_endpoints().isEmpty()
    assert grown.edges.exceptAll(tiny.edges).count() == 150


def test_pagerank_ends_at_a_tolerance(tiny):
    deltas = [r.delta for r in pagerank.pagerank_delta(tiny, 6).orderBy("iter").collect()]
    at = next(i for i, x in enumerate(deltas) if x <= 0.3)
    assert by_id(pagerank.pagerank(tiny, 6, tol=0.3), "rank") == pytest.approx(by_id(pagerank.pagerank(tiny, at + 1), "rank"))


def test_tied_decimals_round_alike(spark, tiny):
    """Sums in another order differ in the last places; what is shown does not."""
    from loomgraph.plans import catalogue

    state = spark.createDataFrame([(0, 0.3954375), (1, 0.3954375 + 1e-16), (2, 0.23181250000000003), (3, 0.2318125)], "id long, rank double")
    assert by_id(catalogue._ranked(state), "rank") == [0.395438, 0.395438, 0.231813, 0.231813]
    a = catalogue._ranked(pagerank.pagerank(tiny)).collect()
    b = catalogue._ranked(pagerank.pagerank(Graph(tiny.vertices, tiny.edges.repartition(7, "weight")))).collect()
    assert sorted(a) == sorted(b)


def test_rounds_merge_edges_where_they_are(spark, tiny):
    """No shuffle of edges or of the state: only the least messages move."""
    from loomgraph.graph import partitioned
    from loomgraph.runtime import checkpointed

    edges = tiny.store("out").by("src")
    edges.count()
    now, _ = checkpointed(partitioned(spark.createDataFrame([(k, k) for k in range(9)], "id long, value long"), "id"))
    active = now.select(F.col("id").alias("src"), "value").hint("merge")
    sent = edges.join(active, "src").groupBy(F.col("dst").alias("id")).agg(F.min("value").alias("new"))
    plan = now.join(sent.hint("merge"), "id", "left")._jdf.queryExecution().executedPlan().toString()
    tiny.release()
    outside = plan.split("InMemoryRelation")[0]
    assert outside.count("Exchange") == 1 and "partial_min" in outside


def test_negative_cycles_are_told(spark):
    loop = Graph.dense(spark, 3, spark.createDataFrame([(0, 1, 1), (1, 2, -3), (2, 0, 1)], SCHEMA))
    with pytest.raises(ValueError, match="cycle"):
        frontier.sssp(loop, 0)
    assert by_id(frontier.sssp(loop, 0, rounds=2), "distance") == [0, 1, -2]


def test_levels_and_components_after_insert(spark, tiny):
    batch = spark.createDataFrame([(3, 4, 2), (0, 3, 1), (7, 8, 1)], SCHEMA)
    grown = updates.insert_edges(tiny, batch)
    assert by_id(frontier.bfs_after_insert(grown, frontier.bfs(tiny, 0), batch), "depth", "parent") == by_id(frontier.bfs(grown, 0), "depth", "parent")
    again = components.components_after_insert(grown, components.weak_components(tiny), batch)
    assert by_id(again, "label") == by_id(components.weak_components(grown), "label") == [0] * 7 + [0, 0]


def test_hubs_over_level_bounds_are_found(spark):
    """In-neighbours beyond any one chunk of a hub's list count for parents and ranks."""
    star = Graph.dense(spark, 102, spark.createDataFrame([(k, 100, 1) for k in range(100)] + [(100, 101, 1), (101, 99, 1)], SCHEMA))
    assert by_id(frontier.bfs(star, 99), "depth", "parent")[99:] == [(0, 99), (1, 99), (2, 100)]
    assert by_id(pagerank.pagerank(star, 1), "rank")[100] == pytest.approx(0.15 + 0.85 * 100)
    parts = adjacency.neighbor_lists(star, "in", most=30).where("id = 100").collect()
    assert len(parts) > 1 and sorted(x for r in parts for x in r.neighbors) == list(range(100))


def test_vertex_sets_and_active_senders(spark, tiny):
    odd = messages.VertexSet(tiny.vertices.where("id % 2 = 1"))
    some = odd.with_ids(spark.range(0, 3)).without_ids(spark.range(1, 2))
    assert sorted(r.id for r in some.ids.collect()) == [0, 2, 3, 5, 7]
    assert sorted(r.id for r in some.both(odd).ids.collect()) == [3, 5, 7]
    asked = spark.createDataFrame([(0,), (1,), (None,), (0,)], "id long")
    assert sorted(((r.id is not None, r.id, r.found) for r in some.has(asked).collect()), key=str) == sorted([(True, 0, True), (True, 0, True), (True, 1, False), (False, None, False)], key=str)
    assert messages.VertexSet.none(tiny).ids.isEmpty() and messages.VertexSet.all(tiny).ids.count() == 9
    state = tiny.vertices.withColumn("v", F.col("id"))
    got = messages.aggregate_messages(tiny, state, F.col("v"), F.sum, active=some.ids)
    assert {r.id: r.value for r in got.collect()} == {1: 2, 2: 0, 3: 2, 0: 6, 6: 5} | {1: 0 + 2}
    sparse = messages.pregel(tiny, state, F.col("v"), F.max, lambda m: {"v": F.coalesce(m, F.col("v"))}, 1, sends=F.col("id") == 3)
    assert by_id(sparse, "v")[0] == 3 and by_id(sparse, "v")[1] == 1


def test_order_of_edges_does_not_matter(spark, tiny):
    """Unsorted lists, batches in any order, and tallies of several tasks: the same degrees, labels, triangles and distances."""
    shuffled = Graph(tiny.vertices, tiny.edges.orderBy(F.xxhash64("dst", "src", "weight")).repartition(5))
    for f in (adjacency.degrees, lambda g: label_propagation.label_propagation(g, 2), triangles.triangles_per_vertex, lambda g: frontier.sssp(g, 0), lambda g: frontier.bfs(g, 0)):
        assert sorted(f(shuffled).collect(), key=str) == sorted(f(tiny).collect(), key=str)
    batch = [(7, 1), (7, 0), (2, 7), (1, 7), (1, 0)]
    one, two = (updates.insert_edges(tiny, spark.createDataFrame(b, "src long, dst long")) for b in (batch, batch[::-1]))
    assert sorted(one.edges.collect()) == sorted(two.edges.collect())
    assert by_id(adjacency.degrees(one), "degree") == [2, 3, 3, 2, 2, 1, 1, 2, 1]


def test_vertices_without_edges_have_no_neighbours(spark, tiny):
    assert adjacency.neighbors(tiny, 7).isEmpty() and adjacency.neighbors(tiny, 7, "in").isEmpty()
    assert adjacency.neighbor_lists(tiny).where("id = 7").isEmpty()
    got = messages.aggregate_messages(tiny, tiny.vertices.where("id = 7"), F.col("dst"), F.min)
    assert got.isEmpty()


def test_push_and_pull_agree(spark, tiny):
    """Messages over stored edges, over plain ones, and of a frontier that names everyone are the same."""
    state = tiny.vertices.withColumn("v", F.col("id") * 10)
    want = sorted(messages.aggregate_messages(tiny, state, F.col("v"), F.sum).collect())
    assert sorted(messages.aggregate_messages(tiny, state, F.col("v"), F.sum, active=tiny.vertices).collect()) == want
    stored = Graph(tiny.vertices, tiny.edges).store("both")
    assert sorted(messages.aggregate_messages(stored, state, F.col("v"), F.sum).collect()) == want
    back = Graph(tiny.vertices, tiny.reverse().edges)
    assert sorted(messages.aggregate_messages(back, state, F.col("v"), F.sum, to="src").collect()) == want
    stored.release()


def test_lines_are_inserted(spark, tiny, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n7 0\n7 1\n20 7\n")
    grown = updates.insert_lines(tiny, str(tmp_path / "e.txt"), 1, 3)
    assert sorted(map(tuple, grown.edges.exceptAll(tiny.edges).collect())) == [(7, 1, 0), (20, 7, 0)]
    assert grown.vertices.where("id = 20").count() == 1


def test_scalar_helpers(spark):
    from loomgraph.functions import derived_weight, log2_up, uniform

    assert [log2_up(n) for n in (1, 2, 3, 4, 5, 1024, 1025)] == [0, 1, 2, 2, 3, 10, 11]
    u = spark.range(2000).select(uniform(F.col("id"), F.lit(1)).alias("u"), derived_weight(F.col("id"), F.lit(3)).alias("w")).agg(F.min("u"), F.max("u"), F.avg("u"), F.min("w"), F.max("w")).first()
    assert 0 <= u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.03 and u[3] >= 1 and u[4] <= 10_000
    some = adjacency.random_sources(Graph.dense(spark, 2000, spark.createDataFrame([], SCHEMA)))
    assert 60 < some.count() < 140 and some.exceptAll(adjacency.random_sources(Graph.dense(spark, 2000, spark.createDataFrame([], SCHEMA)))).isEmpty()


def test_common_neighbours(spark, tiny):
    pairs = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (7, 7)], "a long, b long")
    assert sorted(map(tuple, adjacency.common_neighbors(tiny, pairs).collect())) == [(0, 1, 0), (0, 2, 1), (7, 7, 0)]


def test_directed_triangles_match_loops(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randrange(25), rnd.randrange(25), 1) for _ in range(220)]
    e = {(a, b) for a, b, _ in rows}
    brute = sum((p1, p2) in e and (p1, p3) in e and (p2, p3) in e for p1 in range(25) for p2 in range(p1 + 1, 25) for p3 in range(p1))
    assert triangles.directed_triangle_count(Graph.dense(spark, 25, spark.createDataFrame(rows, SCHEMA))).first()[0] == brute > 0


def test_places_without_python(spark, tiny):
    remap = profile.vertex_remap(tiny.edges)._jdf.queryExecution().toString()
    assert "Python" not in remap and "ExternalRDD" not in remap
    first, rest = updates.split_edges(tiny.edges, 0)
    assert first.isEmpty() and rest.count() == len(TINY)
    assert profile.dense_ids(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from loomgraph import runtime

    conf = SimpleNamespace(get=lambda key: None)
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,512]", True), ("yarn", True), ("local[4]", False), ("local", False)):
        sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None, master=master)
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                runtime.shared_dir(SimpleNamespace(sparkContext=sc))
        else:
            assert runtime.shared_dir(SimpleNamespace(sparkContext=sc))


def test_discarded_tables_are_gone(spark):
    import os

    from loomgraph import runtime

    one = runtime.written(spark.range(3), "one")
    path = one.scratch_path.removeprefix("file://")
    assert os.path.isdir(path) and one.count() == 3
    runtime.discard(one, None, spark.range(1))
    assert not os.path.exists(path)


def test_rmat(spark):
    e = rmat.rmat_edges(spark, 2000, 64, seed=3)
    rows = e.collect()
    assert len(rows) == 2000 and all(0 <= r.src < 64 and 0 <= r.dst < 64 for r in rows)
    assert rows == rmat.rmat_edges(spark, 2000, 64, seed=3).collect()
    low = sum(r.src < 32 and r.dst < 32 for r in rows) / 2000
    assert 0.45 < low < 0.55
    with pytest.raises(ValueError):
        rmat.rmat_edges(spark, 1, 3)


def test_stream_replay_changes_nothing(spark, tiny, tmp_path):
    for i in range(4):
        tiny.edges.where(f"src % 4 = {i}").write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = ingest.edge_stream(spark, str(tmp_path / "in" / "*"), 1)
    q = ingest.stream_insert(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(map(tuple, ingest.snapshot(spark, str(tmp_path / "out")).collect())) == sorted(TINY)
    # a batch that comes again, as after a failure, leaves the same bag; a stream that starts again from its state adds nothing
    for i in range(4):
        batch = spark.read.parquet(str(tmp_path / "out" / f"batch_id={i}")).collect()
        ingest.write_batch(spark.createDataFrame(batch, SCHEMA), i, str(tmp_path / "out"))
        assert sorted(map(tuple, ingest.snapshot(spark, str(tmp_path / "out")).collect())) == sorted(TINY)
    ingest.stream_insert(ingest.edge_stream(spark, str(tmp_path / "in" / "*"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, ingest.snapshot(spark, str(tmp_path / "out")).collect())) == sorted(TINY)
    assert ingest.snapshot(spark, str(tmp_path / "out"), upto=1).count() < len(TINY)


def test_distances_on_a_growing_graph(spark, tiny, tmp_path):
    order = [TINY[5], TINY[0], *TINY[1:5], *TINY[6:]]
    for i in range(3):
        spark.createDataFrame(order[4 * i : 4 * i + 4], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = ingest.edge_stream(spark, str(tmp_path / "in" / "*"), 1)
    ingest.stream_distances(stream, str(tmp_path / "t"), str(tmp_path / "r"), str(tmp_path / "cp"), tiny.vertices, 0).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "r" / "batch_id=2"))
    assert by_id(last, "distance") == by_id(frontier.sssp(tiny, 0), "distance")


def test_running_degrees(spark, tiny, tmp_path):
    for i in range(3):
        tiny.edges.where(f"src % 3 = {i}").write.parquet(str(tmp_path / "in" / f"b{i}"))
    q = ingest.running_degrees(ingest.edge_stream(spark, str(tmp_path / "in" / "*"))).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert dict(map(tuple, spark.table("degrees").collect())) == {0: 2, 1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 8: 1}


def test_empty_graph(spark):
    g = Graph.dense(spark, 3, spark.createDataFrame([], SCHEMA))
    assert by_id(pagerank.pagerank(g, 2), "rank") == pytest.approx([0.15] * 3)
    assert by_id(components.weak_components(g), "label") == [0, 1, 2]
    assert by_id(frontier.sssp(g, 0), "distance") == [0, None, None]
    assert triangles.triangle_count(g).first()[0] == 0
