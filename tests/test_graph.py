"""Golden values on the literal graphs and brute force on small random ones."""

import random

import pytest
from pyspark.sql import functions as F

from topicweft.operators import community as M
from topicweft.operators import graph as G
from topicweft.operators import paths as P

PEOPLE = [(1, "Alice", 28), (2, "Bob", 27), (3, "Charlie", 65), (4, "David", 42), (5, "Ed", 55), (6, "Fran", 50)]
LIKES = [(2, 1, 7), (2, 4, 2), (3, 2, 4), (3, 6, 3), (4, 1, 1), (5, 2, 2), (5, 3, 8), (5, 6, 3)]
COMMUNITY = [(1, 3), (1, 6), (1, 7), (1, 4), (2, 5), (2, 3), (3, 5), (3, 6), (3, 7), (3, 4), (4, 6), (4, 7), (5, 6), (6, 7)]


@pytest.fixture(scope="module")
def people(spark):
    v = spark.createDataFrame(PEOPLE, "id bigint, name string, age int")
    e = spark.createDataFrame(LIKES, "src bigint, dst bigint, attr int")
    return G.Graph(v, e)


@pytest.fixture(scope="module")
def community(spark):
    e = spark.createDataFrame(COMMUNITY, "src bigint, dst bigint").withColumn("attr", F.lit(1))
    return G.Graph.from_edges(e)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def as_dict(df, key="id", value=None):
    value = value or df.columns[1]
    return {r[key]: r[value] for r in df.collect()}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_filters(people):
    assert rows(people.vertices.filter("age > 30").select("id")) == [(3,), (4,), (5,), (6,)]
    assert rows(people.edges.filter("attr > 5")) == [(2, 1, 7), (5, 3, 8)]


def test_degrees(people):
    assert as_dict(G.out_degrees(people.edges)) == {2: 2, 3: 2, 4: 1, 5: 3}
    assert as_dict(G.in_degrees(people.edges)) == {1: 2, 2: 2, 3: 1, 4: 1, 6: 2}
    assert as_dict(G.degrees(people.edges)) == {1: 2, 2: 4, 3: 3, 4: 2, 5: 3, 6: 2}
    assert rows(G.extreme(G.degrees(people.edges), "degree")) == [(2, 4)]
    assert rows(G.extreme(G.degrees(people.edges), "degree", largest=False)) == [(1, 2)]
    assert rows(G.equal_in_out(people).select("id")) == [(2,), (4,)]


def test_self_loop_counts_twice(spark):
    e = spark.createDataFrame([(1, 1), (1, 2)], "src bigint, dst bigint")
    assert as_dict(G.degrees(e)) == {1: 3, 2: 1}


def test_subgraph(people):
    sub = G.subgraph(people, vertex=F.col("age") >= 30)
    assert rows(sub.edges) == [(3, 6, 3), (5, 3, 8), (5, 6, 3)]
    assert sub.vertices.count() == 4


def test_maps_and_triplets(people):
    assert rows(people.map_edges(attr=F.col("attr") * 2).edges)[0] == (2, 1, 14)
    assert people.map_vertices(age=F.col("age") + 10).vertices.agg(F.min("age")).first()[0] == 37
    gap = people.map_triplets(attr=F.col("src_age") - F.col("dst_age")).edges
    assert (5, 3, -10) in rows(gap)
    assert rows(people.reverse().edges) == sorted((d, s, w) for s, d, w in LIKES)
    view = G.triplets(people).filter("src_age > dst_age").select("src_name", "dst_name")
    assert ("Ed", "Bob") in {tuple(r) for r in view.collect()}


def test_messages(people):
    sums = G.aggregate_messages(people, [F.sum("src_age").alias("s")])
    assert as_dict(sums) == {1: 69, 2: 120, 3: 55, 4: 27, 6: 120}
    assert as_dict(G.oldest_follower(people)) == {1: 4, 2: 3, 3: 5, 4: 2, 5: None, 6: 3}


def test_vertex_updates(spark, people):
    props = spark.createDataFrame([(1, 9)], "id bigint, p int")
    joined = G.with_properties(people.vertices, props, {"p": 0})
    assert as_dict(joined, value="p") == {1: 9, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    newer = spark.createDataFrame([(2, 99)], "id bigint, age int")
    assert as_dict(G.update_matching(people.vertices, newer, "age"), value="age")[2] == 99
    assert as_dict(G.update_matching(people.vertices, newer, "age"), value="age")[1] == 28


def test_distances(spark, people):
    start = spark.createDataFrame([(5,)], "id bigint")
    assert as_dict(P.shortest_paths(people.edges, start).select("id", "distance")) == {1: 5, 2: 2, 3: 8, 4: 4, 5: 0, 6: 3}
    assert as_dict(P.bfs(people.edges, start).select("id", "level")) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1}
    assert P.harmonic_closeness(people.edges, start, "attr").first()["closeness"] == pytest.approx(1.408333, abs=1e-6)
    assert P.harmonic_closeness(people.edges, start).first()["closeness"] == pytest.approx(4.0)


def test_bfs_depth_cap_and_unreachable(spark, people):
    start = spark.createDataFrame([(5,)], "id bigint")
    assert P.bfs(people.edges, start, depth=1).count() == 4
    with pytest.raises(P.Unfinished):
        P.bfs(people.edges, start, max_steps=1)
    assert P.bfs(people.edges, start, max_steps=2).count() == 6
    leaf = spark.createDataFrame([(1,)], "id bigint")
    assert rows(P.bfs(people.edges, leaf)) == [(1, 0, 0)]


def test_betweenness_literal(spark):
    e = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (2, 4)], "src bigint, dst bigint")
    found = P.betweenness(e, spark.createDataFrame([(1,)], "id bigint"))
    assert as_dict(found.vertices, value="level") == {2: 1, 4: 1, 3: 2}
    assert as_dict(found.vertices, value="credit") == {2: 2.0, 3: 1.0, 4: 1.0}
    assert set(as_dict(found.vertices, value="sigma").values()) == {1.0}
    assert {(r["src"], r["dst"]): r["credit"] for r in found.edges.collect()} == {(1, 2): 2.0, (1, 4): 1.0, (2, 3): 1.0}


def brandes(edges, root):
    out = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    level, sigma, order = {root: 0}, {root: 1.0}, [root]
    for v in order:
        for w in out.get(v, []):
            if w not in level:
                level[w], sigma[w] = level[v] + 1, 0.0
                order.append(w)
            if level[w] == level[v] + 1:
                sigma[w] += sigma[v]
    credit = dict.fromkeys(order, 1.0)
    for v in reversed(order):
        for w in out.get(v, []):
            if level[w] == level[v] + 1:
                credit[v] += sigma[v] / sigma[w] * credit[w]
    return {(root, v): credit[v] for v in order if v != root}


def test_betweenness_many_roots(spark):
    edges = random_edges(3, 40, 120)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    roots = [0, 1, 2]
    found = P.betweenness(e, spark.createDataFrame([(r,) for r in roots], "id bigint"))
    want = {k: c for r in roots for k, c in brandes(edges, r).items()}
    got = {(r["root"], r["id"]): r["credit"] for r in found.vertices.collect()}
    assert got == pytest.approx(want)


def test_betweenness_with_a_hot_target(spark):
    """Most edges lead to one vertex."""
    edges = [(0, i) for i in range(1, 80)] + [(i, 100) for i in range(1, 80)] + [(100, 101)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = P.betweenness(e, spark.createDataFrame([(0,)], "id bigint"))
    got = {(r["root"], r["id"]): r["credit"] for r in found.vertices.collect()}
    assert got == pytest.approx(brandes(edges, 0))


def test_betweenness_of_isolated_root(spark):
    e = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    found = P.betweenness(e, spark.createDataFrame([(2,)], "id bigint"))
    assert found.vertices.count() == 0 and found.edges.count() == 0


def test_community_values(spark, community):
    assert as_dict(G.degrees(community.edges)) == {1: 4, 2: 2, 3: 6, 4: 4, 5: 3, 6: 5, 7: 4}
    members = spark.createDataFrame([(1,), (4,), (7,)], "id bigint")
    row = M.set_metrics(community, members).first()
    assert (row["edges"], row["cs"]) == (3, 12)
    assert row["phi"] == pytest.approx(0.5) and row["fd"] == pytest.approx(0.5)
    assert row["q"] == pytest.approx(0.030612, abs=1e-6)
    assert M.set_metrics(community, members, whole_volume=True).first()["phi"] == pytest.approx(0.375)


def test_greedy_literal(community):
    assert as_dict(M.greedy_community(community, 1)) == {1: 4, 3: 4, 4: 4, 6: 4, 7: 4}


def greedy(edges, weights, target):
    """Remove all current minima until the target ties the smallest score."""
    alive = {v for e in edges for v in e}
    while True:
        score = dict.fromkeys(alive, 0)
        for (a, b), w in zip(edges, weights):
            if a in alive and b in alive:
                score[a] += w
                score[b] += w
        low = min(score.values())
        if score[target] == low:
            return score
        alive -= {v for v, s in score.items() if s == low}


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_greedy_degree_brute_force(spark, seed):
    edges = random_edges(seed, 30, 110)
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("attr", F.lit(1)))
    for target in (0, 7):
        assert as_dict(M.greedy_community(g, target)) == greedy(edges, [1] * len(edges), target)


def test_greedy_overlap_brute_force(spark):
    edges = random_edges(9, 25, 90)
    rng = random.Random(4)
    attrs = {v: (rng.randrange(20), rng.randrange(9)) for v in range(25)}
    v = spark.createDataFrame([(i, *a) for i, a in attrs.items() if any(i in e for e in edges)], "id bigint, a bigint, b bigint")
    g = G.Graph(v, spark.createDataFrame(edges, "src bigint, dst bigint"))
    weights = [sum(min(x, y) for x, y in zip(attrs[a], attrs[b])) for a, b in edges]
    assert as_dict(M.greedy_community(g, 3, ["a", "b"])) == greedy(edges, weights, 3)


@pytest.mark.parametrize("links", [25, 10**6])
def test_greedy_steps_do_not_grow_with_its_rounds(spark, monkeypatch, links):
    """A chain leaves end by end, 40 rounds of one vertex each, before the target in a denser part is reached; blocks of few links
    settle against each other."""
    monkeypatch.setattr(M, "LINKS_PER_BLOCK", links)
    runs, settle = [], M._Links.core_numbers
    monkeypatch.setattr(M._Links, "core_numbers", lambda self: runs.append(1) or settle(self))
    chain = [(100 + i, 101 + i) for i in range(40)]
    part = [(a, b) for a in range(5) for b in range(a)] + [(4, 5), (3, 5), (5, 140)]
    edges = chain + part
    attrs = {v: (v * 7) % 5 + 1 for e in edges for v in e}
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("attr", F.lit(1)))
    g = G.Graph(spark.createDataFrame(list(attrs.items()), "id bigint, a bigint"), g.edges)
    assert as_dict(M.greedy_community(g, 2)) == greedy(edges, [1] * len(edges), 2)
    assert len(runs) <= 4
    assert as_dict(M.greedy_community(g, 2, ["a"])) == greedy(edges, [min(attrs[a], attrs[b]) for a, b in edges], 2)


def test_greedy_rounds_of_a_core_that_fits_a_block(spark, monkeypatch):
    """The graph does not fit a block, the target's core does: no step per level of the core."""
    edges = [e for e in random_edges(3, 14, 80) if e[0] != e[1]] + [(100 + i, (100 + i * 7) % 500) for i in range(400)]
    edges = sorted({e for e in edges if e[0] != e[1]})
    monkeypatch.setattr(M, "LINKS_PER_BLOCK", 170)
    monkeypatch.setattr(M._Links, "core_numbers", lambda self: pytest.fail("a step of core numbers"))
    attrs = {v: (v * 7) % 11 + 1 for e in edges for v in e}
    v = spark.createDataFrame(list(attrs.items()), "id bigint, a bigint")
    g = G.Graph(v, spark.createDataFrame(edges, "src bigint, dst bigint"))
    weights = [min(attrs[a], attrs[b]) for a, b in edges]
    for target in (2, 5):
        assert as_dict(M.greedy_community(g, target)) == greedy(edges, [1] * len(edges), target)
        assert as_dict(M.greedy_community(g, target, ["a"])) == greedy(edges, weights, target)


def test_greedy_needs_a_vertex(community):
    with pytest.raises(ValueError):
        M.greedy_community(community, 99)


def peel(edges, iterations):
    alive, last = {v for e in edges for v in e}, {}
    last = dict.fromkeys(alive, 0)
    for i in range(1, iterations + 1):
        deg = dict.fromkeys(alive, 0)
        for a, b in edges:
            if a in alive and b in alive:
                deg[a] += 1
                deg[b] += 1
        positive = [d for d in deg.values() if d]
        limit = max(M.alpha(i), min(positive) if positive else 0)
        alive = {v for v, d in deg.items() if d > limit}
        last.update(dict.fromkeys(alive, i))
    return last


@pytest.mark.parametrize("iterations", [3, 20])
def test_peel_brute_force(spark, iterations):
    edges = random_edges(8, 60, 400)
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    found = M.peel(g, iterations)
    assert as_dict(found.vertices, value="last_iter") == peel(edges, iterations)
    last = peel(edges, iterations)
    for row in found.sizes.collect():
        inside = {v for v, i in last.items() if i >= row["iter"]}
        degree = dict.fromkeys(inside, 0)
        for a, b in edges:
            if a in inside and b in inside:
                degree[a] += 1
                degree[b] += 1
        positive = [d for d in degree.values() if d]
        assert (row["vertices"], row["degree_sum"]) == (len(inside), sum(degree.values()))
        assert (row["lo"], row["hi"]) == (min(positive, default=None), max(degree.values()))


def test_peel_until_nothing_is_left(spark):
    edges = random_edges(8, 60, 400)
    found = M.peel(G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint")))
    assert as_dict(found.vertices, value="last_iter") == peel(edges, found.last) and found.at(found.last).count() == 0
    assert found.at(found.last - 1).count() > 0


def test_a_long_chain_is_searched_to_its_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(60)], "src bigint, dst bigint, attr bigint")
    start = spark.createDataFrame([(0,)], "id bigint")
    assert as_dict(P.bfs(chain, start).select("id", "level")) == {i: i for i in range(61)}
    with pytest.raises(P.Unfinished):
        P.shortest_paths(chain, start, max_steps=10)
    with pytest.raises(P.Unfinished):
        P.betweenness(chain, start, max_steps=10)


def test_closeness_in_batches(spark):
    edges = spark.createDataFrame(random_edges(5, 40, 160), "src bigint, dst bigint")
    sources = spark.createDataFrame([(i,) for i in range(10)], "id bigint")
    whole = as_dict(P.harmonic_closeness(edges, sources), value="closeness")
    assert as_dict(P.harmonic_closeness(edges, sources, batch=3), value="closeness") == pytest.approx(whole)


def test_alpha_schedule():
    assert [M.alpha(i) for i in (1, 7, 49, 50, 79, 80, 99, 100)] == [1, 2, 8, 9, 13, 16, 19, 24]


def test_community_metrics_against_sets(spark):
    edges = random_edges(8, 60, 400)
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    found = M.peel(g, 4)
    last = as_dict(found.vertices, value="last_iter")
    base = [(a, b) for a, b in edges if last[a] >= 1 and last[b] >= 1]
    for row in M.community_metrics(g, found).collect():
        inside = {v for v, i in last.items() if i >= row["iter"]}
        e = sum(a in inside and b in inside for a, b in base)
        cut = sum((a in inside) != (b in inside) for a, b in base)
        assert (row["m"], row["edges"], row["cs"]) == (len(inside), e, 2 * cut)
        assert row["cs"] % 2 == 0
        assert row["fa"] == pytest.approx(2 * e / len(inside))


def test_user_tables(spark):
    edges = random_edges(8, 60, 400)
    g = G.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    found = M.peel(g, 3)
    users = spark.createDataFrame([(0, "N"), (1, "P"), (2, None), (900, "P")], "id bigint, label string")
    located = M.located_users(found, users)
    assert as_dict(located, value="label") == {0: "N", 1: "P", 2: "none"}
    assert rows(M.absent_users(users, located).select("id")) == [(900,)]
    assert M.community_index(located).agg(F.sum("users")).first()[0] == 3
    attributes = M.user_attributes(found, located)
    assert attributes.count() == 3
    assert M.user_attributes(found, located, denominator="communities").count() == 3


def test_hub_edges_are_split_and_kept(spark):
    """One source with most edges: same result as without a hub."""
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1, 20)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    with P.adjacency_of(e) as adjacency:
        assert adjacency.hot.any
        assert adjacency.expand(spark.createDataFrame([(0,), (5,)], "id bigint")).count() == 200
    found = P.bfs(e, spark.createDataFrame([(0,)], "id bigint"))
    assert found.filter("level = 1").count() == 199
    assert G.triplets(G.Graph.from_edges(e)).count() == len(edges)


@pytest.mark.parametrize("n", [1, 4, 16])
def test_same_result_on_any_partitioning(spark, partitions, n):
    partitions(n)
    edges = random_edges(3, 40, 120)
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = P.bfs(e, spark.createDataFrame([(0,)], "id bigint"))
    assert found.agg(F.sum(F.col("id") * (F.col("level") + 1) * (F.col("parents") + 1))).first()[0] == bfs_checksum(edges)


def bfs_checksum(edges):
    level, frontier, parents = {0: 0}, [0], {0: 0}
    while frontier:
        hit = {}
        for s, d in edges:
            if s in frontier and d not in level:
                hit[d] = hit.get(d, 0) + 1
        depth = level[frontier[0]] + 1
        for v, n in hit.items():
            level[v], parents[v] = depth, n
        frontier = list(hit)
    return sum(v * (level[v] + 1) * (parents[v] + 1) for v in level)
