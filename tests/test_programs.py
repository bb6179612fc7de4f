"""Vertex programs, bucketed state, and the searches that run on them."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from topicweft.operators import paths as P
from topicweft.operators import programs as V
from topicweft.plans.buckets import State, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_edges(n, m, seed, most=60):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)): rng.randint(0, most) for _ in range(m)}.items())


def edge_frame(spark, edges):
    return spark.createDataFrame([(s, d, w) for (s, d), w in edges], "src bigint, dst bigint, attr bigint")


def dijkstra(edges, source, allowed=lambda s, d, w: True, hops=False):
    out = {}
    near = {}
    for (s, d), w in edges:
        near.setdefault(s, []).append((d, w))
    queue = [(0, source)]
    while queue:
        dist, v = heapq.heappop(queue)
        if v in out:
            continue
        out[v] = dist
        for d, w in near.get(v, []):
            if d not in out and allowed(v, d, w):
                heapq.heappush(queue, (dist + (1 if hops else w), d))
    return out


def levels():
    return V.Program(
        message={"one": F.lit(1)}, merge={"n": F.count("one")}, update=lambda step: {"level": F.lit(step)}, changed=F.col("level").isNull()
    )


def test_state_keeps_the_newest_value_in_few_runs(spark):
    store = Store(spark, "state-test")
    state = State(store, ["id"], {"id": "bigint", "v": "bigint"})
    want = {}
    for step in range(18):
        new = {(step * 7 + i) % 30: step for i in range(3)}
        store.save(spark.createDataFrame(list(new.items()), "id bigint, v bigint"), f"s{step}", ["id"], deal=True)
        for name in state.push(f"s{step}", 3):
            store.drop(name)
        want |= new
    assert len(state.runs) <= 6
    assert rows(state.table()) == sorted(want.items())
    asked = spark.range(35).select("id")
    assert {r.id: r.v for r in state.look(asked).collect()} == {i: want.get(i) for i in range(35)}
    store.close()


def test_a_step_exchanges_messages_only(spark):
    """One exchange, of the merged messages: none over the edges or the state (no broadcasts, so that the plan shows it)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = Store(spark, "plan-test")
    try:
        edges = spark.range(2000).select((F.col("id") % 500).alias("src"), (F.col("id") * 7 % 900).alias("dst"))
        adjacency = V.Adjacency(store, edges)
        state = State(store, ["id"], {"id": "bigint", "level": "int"})
        for k in range(2):
            store.save(spark.range(k, 500, 2).select("id", F.lit(k).alias("level")), f"run{k}", ["id"], deal=True)
            state.runs.append((f"run{k}", 250))
        step = V._step(state, adjacency, store.read("run1", state.schema, ["id"]), levels(), 2)
        plan = step._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1]
        assert initial.count("Exchange") == 1 and "HashAggregate" in initial.split("Exchange hashpartitioning")[1].split("\n")[1]
        assert initial.count("Bucketed: true") == 4
        assert {r.id for r in step.collect()} == {d for s, d in edges.collect() if s % 2} - set(range(500))
    finally:
        store.close()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stopped_loop_goes_on_where_it_was(spark):
    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0, 0)], "id bigint, level int")
    seen = []

    def fail(step, changed):
        seen.append(step)
        if step == 9:
            raise InterruptedError(step)

    store = Store(spark, "resume-test")
    with pytest.raises(InterruptedError):
        V._iterate(store, edges, start, levels(), None, None, fail, None)
    store.close()
    assert Store(spark, "", store.path).last()["step"] == 8
    done = V.iterate(edges, start, levels(), resume=store.path, each_step=lambda step, changed: seen.append(step))
    assert seen == [*range(1, 10), *range(9, 31)] and done.steps == 30
    assert rows(done.state) == [(i, i) for i in range(31)]
    again = V.iterate(edges, start, levels(), resume=store.path)
    assert rows(again.state) == [(i, i) for i in range(31)]


def test_a_program_of_the_users_own(spark):
    """The largest label that reaches a vertex, and by how many edges it came in."""
    edges = random_edges(60, 90, 4)
    start = spark.createDataFrame([(i, (i * 37) % 61, 0) for i in range(60)], "id bigint, label bigint, came bigint")
    program = V.Program(
        message={"label_in": F.col("src_label")}, merge={"most": F.max("label_in"), "n": F.count("label_in")},
        update=lambda step: {"label": F.greatest("label", "most"), "came": F.col("n")}, changed=F.col("most") > F.col("label"),
    )
    got = {r.id: r.label for r in V.iterate(edge_frame(spark, edges), start, program).state.collect()}
    want = {i: (i * 37) % 61 for i in range(60)}
    for v in range(60):
        for reached in dijkstra(edges, v):
            want[reached] = max(want[reached], (v * 37) % 61)
    assert got == want


def test_limits_and_empty_starts(spark):
    edges = spark.range(6).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0, 0)], "id bigint, level int")
    assert V.iterate(edges, start, levels(), stop_after=2).state.count() == 3
    with pytest.raises(V.Unfinished):
        V.iterate(edges, start, levels(), max_steps=3)
    assert V.iterate(edges, start, levels(), max_steps=6).steps == 6
    none = V.iterate(edges, start.limit(0), levels())
    assert none.steps == 0 and none.state.count() == 0
    assert rows(V.iterate(edges.limit(0), start, levels()).state) == [(0, 0)]


def test_ranks_of_a_cycle_and_a_sink(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src bigint, dst bigint")
    vertices = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id bigint")
    got = {r.id: r.rank for r in V.rank_to_tolerance(edges, vertices, 1e-3).collect()}
    a, b = 1.0, 1.0
    for _ in range(200):
        a, b = 0.15 + 0.85 * b / 2, 0.15 + 0.85 * a
    assert got == pytest.approx({1: a, 2: b, 3: 0.15 + 0.85 * b / 2, 4: 0.15}, abs=2e-2)


def test_ranks_look_up_no_old_values(spark, monkeypatch):
    """A rank is the sum of its gains over more steps than runs are kept; no step joins the state."""
    from topicweft.plans import buckets

    monkeypatch.setattr(buckets.State, "look", lambda *_: pytest.fail("a look at the state"))
    pairs = [p for p, _ in random_edges(25, 80, 4)]
    vertices = spark.range(26)
    got = {r.id: r.rank for r in V.rank_to_tolerance(spark.createDataFrame(pairs, "src bigint, dst bigint"), vertices, 1e-3).collect()}
    fan = {s: sum(a == s for a, _ in pairs) for s, _ in pairs}
    gain = want = dict.fromkeys(range(26), 0.15)
    steps = 0
    while any(gain[s] > 1e-3 for s in fan if s in gain):
        sent = [(d, gain[s] / fan[s]) for s, d in pairs if gain.get(s, 0) > 1e-3]
        gain = {v: 0.85 * sum(x for d, x in sent if d == v) for v in {d for d, _ in sent}}
        want = {v: r + gain.get(v, 0) for v, r in want.items()}
        steps += 1
    assert steps > buckets.MOST_RUNS and got == pytest.approx(want)


@pytest.mark.parametrize("width", [None, 12.0])
def test_settled_ranges_give_shortest_paths(spark, width):
    edges = random_edges(60, 150, 8)
    sources = [0, 5, 37]
    got = {(r.source, r.id): r.distance for r in P.shortest_paths(edge_frame(spark, edges), spark.createDataFrame([(s,) for s in sources], "id bigint"), width=width).collect()}
    assert got == {(s, v): d for s in sources for v, d in dijkstra(edges, s).items()}


def test_barred_edges_per_source(spark):
    edges = random_edges(60, 200, 2)
    sources = spark.createDataFrame([(1, 10), (1, 40), (2, 25)], "id bigint, most bigint")
    for hops in (False, True):
        found = P.shortest_paths(edge_frame(spark, edges), sources, None if hops else "attr", F.col("attr") <= F.col("most"))
        got = {(r.source, r.most, r.id): r.distance for r in found.collect()}
        want = {}
        for s, most in ((1, 10), (1, 40), (2, 25)):
            want |= {(s, most, v): d for v, d in dijkstra(edges, s, lambda a, b, w: w <= most, hops).items()}  # noqa: B023
        assert got == want


@pytest.mark.parametrize("batch", [4096, 5])
def test_closeness_of_all_vertices_by_masks(spark, batch):
    edges = random_edges(90, 260, 3)
    sources = spark.createDataFrame([(i, 30 + i % 2 * 20) for i in range(91)], "id bigint, most bigint")
    if batch == 5:
        sources = sources.filter("id < 12")
    found = P.harmonic_closeness(edge_frame(spark, edges), sources, allowed=F.col("attr") <= F.col("most"), batch=batch)
    got = {(r.id, r.most): r.closeness for r in found.collect()}
    want = {}
    for s, most in sources.collect():
        reach = dijkstra(edges, s, lambda a, b, w: w <= most, True)  # noqa: B023
        want[s, most] = sum(1 / d for d in reach.values() if d)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("together", [64, 3])
def test_betweenness_totals_are_sums_over_roots(spark, together):
    edges = edge_frame(spark, random_edges(50, 120, 6)).select("src", "dst")
    roots = spark.createDataFrame([(i,) for i in (0, 3, 9, 11, 20, 31, 49)], "id bigint")
    totals = P.betweenness_totals(edges, roots, together)
    whole = P.betweenness(edges, roots)
    want = {r.id: (r.n, r.c) for r in whole.vertices.groupBy("id").agg(F.count("*").alias("n"), F.sum("credit").alias("c")).collect()}
    got = {r.id: (r.roots, r.credit) for r in totals.vertices.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
    links = {(r.src, r.dst): r.c for r in whole.edges.groupBy("src", "dst").agg(F.sum("credit").alias("c")).collect()}
    assert {(r.src, r.dst): r.credit for r in totals.edges.collect()} == pytest.approx(links)


def test_betweenness_totals_keep_no_row_per_root_and_vertex(spark):
    """Rows per vertex and level, not per vertex and root: 60 roots that all reach the same long way."""
    from topicweft.operators import credit

    rows, saved = [], credit.Scratch.save

    def counted(self, df, name):
        out = saved(self, df, name)
        if name.startswith("reached"):
            rows.append(out.count())
        return out

    edges = spark.createDataFrame([(r, 100) for r in range(60)] + [(100 + i, 101 + i) for i in range(5)], "src bigint, dst bigint")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(credit.Scratch, "save", counted)
        patch.setattr(credit, "FEWEST_LINKS", 10)
        totals = P.betweenness_totals(edges, spark.range(60))
    assert rows == [60, 1, 1, 1, 1, 1, 1, 0]
    assert {r.id: (r.roots, r.credit) for r in totals.vertices.collect()} == {100 + i: (60, 60.0 * (6 - i)) for i in range(6)}
    links = {(r.src, r.dst): r.credit for r in totals.edges.collect()}
    assert links == {(r, 100): 6.0 for r in range(60)} | {(100 + i, 101 + i): 60.0 * (5 - i) for i in range(5)}


def test_betweenness_totals_of_many_roots_take_no_table_per_batch(spark, monkeypatch):
    """Tasks follow parts of the roots over all links; the totals are those of the batches, parallel links and loops among them."""
    from topicweft.operators import credit

    edges = edge_frame(spark, random_edges(70, 210, 8) + [((3, 3), 1), ((3, 4), 1), ((3, 4), 2), ((4, 9), 1), ((200, 201), 1)]).select("src", "dst")
    roots = spark.range(40).unionByName(spark.createDataFrame([(200,), (999,)], "id bigint"))
    monkeypatch.setattr(credit, "MOST_LINKS_IN_A_TASK", 0)
    want = P.betweenness_totals(edges, roots, 16)
    monkeypatch.undo()
    monkeypatch.setattr(credit, "SUMS_PER_ROW", 7)
    monkeypatch.setattr(credit, "_batch", lambda *_: pytest.fail("a batch"))
    got = P.betweenness_totals(edges, roots, 16)
    assert {r.id: (r.roots, pytest.approx(r.credit)) for r in want.vertices.collect()} == {r.id: (r.roots, r.credit) for r in got.vertices.collect()}
    links = {(r.src, r.dst): r.credit for r in want.edges.collect()}
    assert {(r.src, r.dst): r.credit for r in got.edges.collect()} == pytest.approx(links) and links[200, 201] == 1.0


def test_betweenness_totals_without_roots_or_edges(spark):
    edges = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    none = P.betweenness_totals(edges, spark.range(0))
    assert none.vertices.count() == none.edges.count() == 0
    alone = P.betweenness_totals(edges.limit(0), spark.range(3))
    assert alone.vertices.count() == alone.edges.count() == 0
