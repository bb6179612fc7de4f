"""Core peeling, community search and community measures.

Peeled snapshots are nested, so a row per vertex (``id, degree, last_iter``: the last
snapshot that holds it and its degree there) and a row of sums per iteration answer every
question about every community at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .graph import Graph, degrees, ends, triplets
from .paths import adjacency_of, steps

LEFT = "id bigint, degree bigint, last_iter int"
SIZES = "iter int, vertices bigint, degree_sum bigint, lo bigint, hi bigint"


def alpha(iteration: int) -> int:
    """Smallest degree to survive. The steps of the schedule."""
    for below, base, period in ((50, 1, 7), (80, 2, 7), (100, 3, 6)):
        if iteration < below:
            return base + iteration // period
    return 4 + iteration // 5


class Peeling:
    """Result of a peeling run.

    ``vertices(id, degree, last_iter)``; ``sizes`` has a row per snapshot with its number
    of vertices, degree sum and smallest positive and largest degree; snapshot 0 is the graph.
    """

    def __init__(self, vertices: DataFrame, sizes: list[tuple], thresholds: list[tuple[int, int, int]]):
        self.vertices = vertices
        self._sizes = sizes
        self._thresholds = thresholds

    @property
    def last(self) -> int:
        return len(self._thresholds)

    @property
    def steps(self) -> DataFrame:
        """``iter, alpha, min_degree``: one row per iteration."""
        return self.vertices.sparkSession.createDataFrame(self._thresholds, "iter int, alpha int, min_degree bigint")

    @property
    def sizes(self) -> DataFrame:
        """``iter, vertices, degree_sum, lo, hi`` of the snapshots that aren't empty."""
        return self.vertices.sparkSession.createDataFrame([s for s in self._sizes if s[1]], SIZES)

    def at(self, iteration: int) -> DataFrame:
        """Vertices alive after the iteration."""
        return self.vertices.filter(F.col("last_iter") >= iteration).select("id")


def peel(graph: Graph, iterations: int | None = None, schedule: Callable[[int], int] = alpha) -> Peeling:
    """Per iteration keep the vertices whose degree exceeds both the schedule and
    the smallest positive degree, until nothing is left (or for ``iterations``).

    Degrees are kept up to date by subtracting the edges of removed vertices, so an iteration
    shuffles vertex rows and the removed vertices' edges only. A vertex is kept once, when it
    leaves; of the state only the current table stays, and its sums are taken while it is written.
    """
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "peel")
    sizes, thresholds = [], []

    def saved(df: DataFrame, iteration: int) -> DataFrame:
        seen = Observation()
        measures = [
            F.count(F.lit(1)).alias("n"), F.sum("degree").alias("total"),
            F.min(F.when(F.col("degree") > 0, F.col("degree"))).alias("lo"), F.max("degree").alias("hi"),
        ]
        out = scratch.save(df.observe(seen, *measures), f"alive-{iteration}")
        found = seen.get
        sizes.append((iteration, found["n"], found["total"], found["lo"], found["hi"]))
        return out

    start = graph.vertices.select("id").join(degrees(graph.edges), "id", "left").na.fill(0, ["degree"])
    alive = saved(start, 0)
    both = ends(graph.edges).select(F.col("id").alias("src"), F.col("other").alias("dst"))
    with adjacency_of(both, alive.select(F.col("id").alias("src"), F.col("degree").alias("n"))) as adjacency:
        for i in steps(None, "peeling"):
            n, smallest = sizes[-1][1], sizes[-1][3] or 0
            if not n or (iterations is not None and i > iterations):
                break
            thresholds.append((i, schedule(i), smallest))
            limit = max(schedule(i), smallest)
            gone = scratch.save(alive.filter(F.col("degree") <= limit), f"left/last_iter={i - 1}").select("id")
            lost = adjacency.expand(gone).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
            alive = saved(
                alive.filter(F.col("degree") > limit)
                .join(lost, "id", "left")
                .select("id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")),
                i,
            )
            scratch.drop(f"alive-{i - 1}")
    rest = alive.withColumn("last_iter", F.lit(len(thresholds)))
    vertices = scratch.table("left", LEFT).unionByName(rest) if thresholds else rest
    return Peeling(vertices, sizes, thresholds)


def users_kept(peeling: Peeling, users: DataFrame) -> DataFrame:
    """``iter, users``: listed users alive after each iteration, from one row per iteration."""
    last = (
        peeling.vertices.join(users.select("id").distinct(), "id", "left_semi")
        .groupBy("last_iter").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        last.withColumn("iter", F.explode(F.sequence(F.lit(0), "last_iter")))
        .groupBy("iter").agg(F.sum("n").alias("users"))
    )


def peel_stats(peeling: Peeling, users: DataFrame) -> DataFrame:
    """Per iteration: threshold parts, vertices and edges left, listed users
    removed and kept."""
    size = peeling.sizes.select("iter", "vertices", (F.col("degree_sum") / 2).cast("long").alias("edges"))
    kept = users_kept(peeling, users)
    before = kept.select((F.col("iter") + 1).alias("iter"), F.col("users").alias("_before"))
    per_iter = peeling.steps.join(size, "iter", "left").join(kept.withColumnRenamed("users", "users_kept"), "iter", "left")
    return (
        per_iter.na.fill(0, ["vertices", "edges", "users_kept"])
        .join(before, "iter", "left")
        .select(
            "iter", "alpha", "min_degree", "vertices", "edges", "users_kept",
            (F.coalesce("_before", F.lit(0)) - F.col("users_kept")).alias("users_removed"),
        )
    )


def located_users(peeling: Peeling, users: DataFrame) -> DataFrame:
    """Listed users with the last snapshot that holds them and their label
    (``none`` when the list has no label)."""
    last = peeling.vertices.select("id", F.col("last_iter").alias("iter"))
    return users.join(last, "id").select("id", "iter", F.coalesce("label", F.lit("none")).alias("label"))


def community_index(located: DataFrame) -> DataFrame:
    """Users per community level."""
    return located.groupBy("iter").agg(F.count(F.lit(1)).alias("users"))


def absent_users(users: DataFrame, found: DataFrame) -> DataFrame:
    return users.join(found.select("id"), "id", "left_anti")


def removed_per_iteration(peeling: Peeling) -> DataFrame:
    """``id, iter, degree`` of the vertices taken out in each iteration."""
    return peeling.vertices.filter(F.col("last_iter") < peeling.last).select(
        "id", (F.col("last_iter") + 1).alias("iter"), "degree"
    )


def users_in_removed(removed: DataFrame, users: DataFrame) -> DataFrame:
    """Labelled users found in the removed-vertex sets, with iteration and degree."""
    return users.join(removed, "id").select("id", "iter", "degree", "label")


def new_users(candidates: DataFrame, known: DataFrame, located: DataFrame) -> DataFrame:
    """Users of the first list that are not in the second, with their community."""
    fresh = candidates.select("id").join(known.select("id"), "id", "left_anti")
    return fresh.join(located.select("id", "iter"), "id")


def edge_levels(graph: Graph, vertices: DataFrame) -> DataFrame:
    """Edges with the last snapshot of their lower and higher end."""
    view = triplets(Graph(vertices.select("id", "last_iter"), graph.edges))
    return view.select(
        *graph.edges.columns,
        F.least("src_last_iter", "dst_last_iter").alias("lo"),
        F.greatest("src_last_iter", "dst_last_iter").alias("hi"),
    )


def community_metrics(graph: Graph, peeling: Peeling, base: int = 1) -> DataFrame:
    """Size, edges, density, degrees, boundary, modularity share and conductance
    of every community after snapshot ``base``, against snapshot ``base``.

    Edges are read once, into one count per pair of end levels (at most
    iterations squared rows); each community is a sum over that small table.
    """
    size = peeling.sizes.filter(F.col("iter") > base).select(
        "iter", F.col("vertices").alias("m"), "degree_sum", F.col("lo").alias("dm")
    )
    pairs = (
        edge_levels(graph, peeling.vertices)
        .filter(F.col("lo") >= base)
        .groupBy("lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_level = pairs.withColumn("iter", F.explode(F.sequence(F.lit(base + 1), F.lit(max(peeling.last, base + 1)))))
    cut = (F.col("lo") < F.col("iter")) & (F.col("hi") >= F.col("iter"))
    sums = per_level.groupBy("iter").agg(
        F.sum("n").alias("all_edges"),
        F.sum(F.when(F.col("lo") >= F.col("iter"), F.col("n")).otherwise(0)).alias("edges"),
        F.sum(F.when(F.col("hi") < F.col("iter"), F.col("n")).otherwise(0)).alias("rest_edges"),
        (2 * F.sum(F.when(cut, F.col("n")).otherwise(0))).alias("cs"),
    )
    e, m, half_cs = F.col("edges").cast("double"), F.col("m").cast("double"), 0.5 * F.col("cs")
    whole = F.col("all_edges").cast("double")
    volume = 2 * e + half_cs
    return size.join(sums, "iter").select(
        "iter", "m", "edges",
        F.when(F.col("m") > 1, e / (m * (m - 1))).alias("fd"),
        "dm",
        (F.col("degree_sum") / m).alias("fa"),
        "cs",
        (e / whole - 0.25 * (volume / whole) * (volume / whole)).alias("q"),
        (half_cs / F.nullif(F.least(volume, 2.0 * F.col("rest_edges") + half_cs), F.lit(0.0))).alias("phi"),
    )


def set_metrics(graph: Graph, members: DataFrame, whole_volume: bool = False) -> DataFrame:
    """The measures of one vertex set against its graph. ``whole_volume`` puts the degree
    sum of the graph in the place of the set's own in the conductance."""
    marked = graph.vertices.select("id").join(members.select("id", F.lit(1).alias("inside")), "id", "left").na.fill(0)
    pairs = triplets(Graph(marked, graph.edges)).agg(
        F.count(F.lit(1)).alias("all_edges"),
        F.coalesce(F.sum(F.col("src_inside") * F.col("dst_inside")), F.lit(0)).alias("edges"),
        F.coalesce(F.sum(F.when(F.col("src_inside") != F.col("dst_inside"), 1).otherwise(0)), F.lit(0)).alias("cut"),
    )
    m = members.agg(F.count(F.lit(1)).cast("double").alias("m")).scalar()
    e, cut, whole = F.col("edges").cast("double"), F.col("cut").cast("double"), F.col("all_edges").cast("double")
    outside = 2 * (whole - e - cut) + cut
    volume = 2 * e + cut
    inside = 2 * whole + cut if whole_volume else volume
    return pairs.select(
        m.alias("m"), "edges", (2 * F.col("cut")).alias("cs"),
        (e / (m * (m - 1))).alias("fd"),
        (e / whole - 0.25 * (volume / whole) * (volume / whole)).alias("q"),
        (cut / F.least(inside, outside)).alias("phi"),
    )


def weighted_averages(metrics: DataFrame, index: DataFrame, min_iter: int) -> DataFrame:
    """Averages of the measures, each community weighted by its listed users."""
    rows = metrics.join(index, "iter").filter(F.col("iter") >= min_iter)
    weight = F.sum("users")
    return rows.agg(
        weight.alias("users"),
        *[(F.sum(F.col(c) * F.col("users")) / weight).alias(f"avg_{c}") for c in ("m", "fd", "dm", "fa", "q", "phi")],
    )


def user_attributes(peeling: Peeling, located: DataFrame, denominator: str = "users") -> DataFrame:
    """Per listed user, in the community of its last snapshot: relative degree
    ``(deg - min) / (max - min)``, community size and label agreement (mean of
    +1, or -1 for label ``N``)."""
    bounds = peeling.sizes.select("iter", "lo", "hi", F.col("vertices").alias("community_size"))
    sign = F.when(F.col("label") == "N", -1.0).otherwise(1.0)
    votes = located.groupBy("iter").agg(F.sum(sign).alias("_sum"), F.count(F.lit(1)).alias("_users"))
    if denominator == "communities":
        parts = votes.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        parts = F.col("_users")
    per_community = bounds.join(votes, "iter")  # one row per iteration
    return (
        located.join(peeling.vertices.select("id", "degree"), "id")
        .join(per_community, "iter")
        .select(
            "id", "iter",
            ((F.col("degree") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).alias("relative_degree"),
            "community_size",
            (F.col("_sum") / parts).alias("agreement"),
        )
    )


def overlap(columns: list[str]) -> Column:
    """Sum over the attributes of the smaller of the two ends' values."""
    out = F.lit(0).cast("long")
    for c in columns:
        out = out + F.least(f"src_{c}", f"dst_{c}")
    return out


def overlap_score(graph: Graph, columns: list[str]) -> DataFrame:
    """Per vertex the overlap with its in-neighbours, 0 without in-edges."""
    received = triplets(graph).groupBy(F.col("dst").alias("id")).agg(F.sum(overlap(columns)).alias("score"))
    return graph.vertices.select("id").join(received, "id", "left").na.fill(0, ["score"])


LINKS_PER_BLOCK = 2_000_000


def _leave_order(src: np.ndarray, dst: np.ndarray, w: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The core bounds of the vertices ``src``, which have all their links here: the smallest score leaves first, and a vertex
    from elsewhere (only in ``dst``) when its own bound is the smallest value."""
    ids, s = np.unique(src, return_inverse=True)
    n = len(ids)
    everyone, d = np.unique(np.concatenate([ids, dst]), return_inverse=True)
    place = np.full(len(everyone), -1)
    place[d[:n]] = np.arange(n)
    others = np.flatnonzero(place < 0)
    place[others] = np.arange(n, n + len(others))
    d = place[d[n:]]
    value = np.zeros(n + len(others), np.int64)
    np.add.at(value, s, w)
    far = d >= n
    value[d[far]] = bound[far]
    order = np.argsort(d, kind="stable")
    first = np.searchsorted(d[order], np.arange(len(value) + 1)).tolist()
    s, w, value = s[order], w[order], value.tolist()
    waiting = [(x, v) for v, x in enumerate(value)]
    heapq.heapify(waiting)
    left, core, level = [False] * len(value), [0] * n, 0
    while waiting:
        x, v = heapq.heappop(waiting)
        if left[v] or x != value[v]:
            continue
        left[v], level = True, max(level, x)
        if v < n:
            core[v] = level
        part = slice(first[v], first[v + 1])
        for u, lost in zip(s[part].tolist(), w[part].tolist()):
            if not left[u]:
                value[u] -= lost
                heapq.heappush(waiting, (value[u], u))
    return ids, np.array(core, np.int64)


def _block_bounds(links: pa.Table) -> pa.Table:
    ids, core = _leave_order(*[links.column(c).to_numpy() for c in ("src", "dst", "w", "bound")])
    return pa.table({"id": ids, "bound": core})


def _search(target: int) -> Callable[[pa.Table], pa.Table]:
    """The rounds of ``greedy_community`` over links that one task can hold."""

    def left_over(links: pa.Table) -> pa.Table:
        src, dst, w = [links.column(c).to_numpy() for c in ("src", "dst", "w")]
        ids, s = np.unique(src, return_inverse=True)
        order = np.argsort(s, kind="stable")
        first = np.searchsorted(s[order], np.arange(len(ids) + 1))
        value = np.add.reduceat(w[order], first[:-1]).tolist()
        d, w, first = np.searchsorted(ids, dst)[order], w[order], first.tolist()
        mine, left = int(np.searchsorted(ids, target)), np.zeros(len(ids), bool)
        waiting = [(x, v) for v, x in enumerate(value)]
        heapq.heapify(waiting)
        while True:
            while left[waiting[0][1]] or waiting[0][0] != value[waiting[0][1]]:
                heapq.heappop(waiting)
            lowest, gone = waiting[0][0], []
            if value[mine] <= lowest:
                break
            while waiting and waiting[0][0] == lowest:
                v = heapq.heappop(waiting)[1]
                if not left[v] and value[v] == lowest:
                    left[v] = True
                    gone.append(v)
            for v in gone:
                part = slice(first[v], first[v + 1])
                for u, lost in zip(d[part].tolist(), w[part].tolist()):
                    if not left[u]:
                        value[u] -= lost
                        heapq.heappush(waiting, (value[u], u))
        return pa.table({"id": ids[~left], "score": np.array(value, np.int64)[~left]})

    return left_over


class _Links:
    """Weighted links in both directions, ``src, dst, w``, with the scores ``own`` and ``bound`` that the core numbers of ``src`` and
    ``dst`` do not exceed."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        self.scratch, self.made, self.floor = scratch, 0, 0
        self.rows, self.name, self.n, _ = self._save(rows, F.lit(0))
        self.score()

    def _save(self, df: DataFrame, measure: Column) -> tuple[DataFrame, str, int, int]:
        self.made += 1
        seen, name = Observation(), f"links-{self.made}"
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(measure), F.lit(0)).alias("m"))
        return self.scratch.save(counted, name), name, seen.get["n"], seen.get["m"]

    def replace(self, rows: DataFrame, measure: Column | None = None) -> int:
        before = self.name
        self.rows, self.name, self.n, found = self._save(rows, F.lit(0) if measure is None else measure)
        self.scratch.drop(before)
        return found

    def score(self, rows: DataFrame | None = None) -> None:
        """Put the ends' present scores on the links (``rows`` in place of all), and drop those with an end below the floor."""
        rows = (self.rows if rows is None else rows).select("src", "dst", "w")
        self.made += 1
        name = f"scores-{self.made}"
        sums = self.scratch.save(rows.groupBy("src").agg(F.sum("w").alias("own")), name).filter(F.col("own") >= self.floor)
        far = sums.select(F.col("src").alias("dst"), F.col("own").alias("bound"))
        self.replace(rows.join(sums, "src").join(far, "dst").select("src", "dst", "w", "own", "bound"))
        self.scratch.drop(name)

    def has(self, target: int) -> bool:
        return not self.rows.filter(F.col("src") == target).isEmpty()

    def one_block(self, rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return rows.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(run, schema)

    def narrow(self, target: int) -> bool:
        """Drop links outside the target's core until the rest fits a block; False if that core itself is larger.

        The target's core number among the vertices of highest score, as many as fit a block, is a floor for its core number among
        all, and vertices below the floor are outside its core. The floor is looked for again while it rises.
        """
        rising = True
        while self.n > LINKS_PER_BLOCK:
            before, floor = self.n, self.floor
            if rising:
                self.floor = max(floor, self._floor(target))
            inside = (F.col("own") >= self.floor) & (F.col("bound") >= self.floor)
            self.score(self.rows.filter(inside))
            if self.n == before and self.floor == floor:
                if rising:
                    return False
                rising = True
            else:
                rising = self.floor > floor
        return True

    def _floor(self, target: int) -> int:
        lower = F.least("own", "bound")
        share = max(0.0, 1.0 - LINKS_PER_BLOCK / self.n)
        least = self.rows.agg(F.percentile_approx(lower, share, 10_000)).first()[0]
        mine = (F.col("src") == target) | (F.col("own") > least)
        high = self.rows.filter(mine & ((F.col("dst") == target) | (F.col("bound") > least)))
        found = self.one_block(high, _block_bounds, "id bigint, bound bigint").filter(F.col("id") == target).first()
        return found["bound"] if found else 0

    def core_numbers(self) -> tuple[DataFrame, str]:
        """``id, bound``: the core number of every vertex that has links, and the name of the table.

        A core number is the largest value that the links to vertices of at least that value add up to. A block of vertices settles
        its own bounds against those of the others; blocks repeat this until no bound falls. They grow in number with the links.
        """
        blocks = max(1, -(-self.n // LINKS_PER_BLOCK))
        while True:
            self.made += 1
            name = f"bounds-{self.made}"
            dealt = self.rows.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(blocks)))
            found = self.scratch.save(dealt.groupBy("block").applyInArrow(_block_bounds, "id bigint, bound bigint"), name)
            if blocks == 1:
                return found, name
            news = found.select(F.col("id").alias("dst"), F.col("bound").alias("_new"))
            fell = (F.col("_new") < F.col("bound")).cast("int").alias("fell")
            joined = self.rows.join(news, "dst").select("src", "dst", "w", "own", F.col("_new").alias("bound"), fell)
            if not self.replace(joined, F.col("fell")):
                return found, name
            self.scratch.drop(name)


def greedy_community(graph: Graph, target: int, columns: list[str] | None = None) -> DataFrame:
    """``id, score`` left when the vertices of smallest score are removed round
    by round until the target has the smallest score.

    The score of a vertex is the weight of its incident edges among the vertices
    left: 1 per edge (its degree), or the overlap of the attribute ``columns``.

    Every vertex outside the target's core, the largest set in which all scores
    reach the highest value the target can keep, leaves before any vertex inside
    it. This holds in every round, so vertices known to lie outside it are dropped
    at once, and where the rest fits a block of links its rounds are one task's. Of a larger
    core a step drops all that is outside it and then the minima inside it: the cascade of small rounds that
    a removal sets off is part of the next step's core numbers.
    """
    scratch = Scratch(graph.edges.sparkSession, "greedy")
    weight = overlap(columns) if columns else F.lit(1).cast("long")
    weighted = triplets(graph) if columns else graph.edges
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    directed = weighted.select(F.explode(both).alias("e"), weight.alias("w")).select("e.*", "w")
    links = _Links(scratch, directed.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0"))
    alive = graph.vertices.select(F.col("id").cast("long"))
    if alive.filter(F.col("id") == target).isEmpty():
        raise ValueError("the target is not a vertex of the graph")
    for i in steps(None, "the search"):
        if not links.has(target):
            scores = links.rows.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("score"))
            return alive.join(scores, "id", "left").na.fill(0, ["score"])
        if links.narrow(target):
            return scratch.save(links.one_block(links.rows, _search(target), "id bigint, score bigint"), "left")
        bounds, made = links.core_numbers()
        level = bounds.filter(F.col("id") == target).first()["bound"]
        core = alive.select("id").join(bounds, "id").filter(F.col("bound") >= level)
        inside = bounds.filter(F.col("bound") >= level)
        ends_inside = links.rows.select("src", "dst", "w").join(inside.select(F.col("id").alias("dst")), "dst")
        sums = ends_inside.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("score"))
        seen = Observation()
        scored = core.join(sums, "id", "left").na.fill(0, ["score"]).select("id", "score")
        own = F.max(F.when(F.col("id") == target, F.col("score"))).alias("own")
        alive = scratch.save(scored.observe(seen, F.min("score").alias("smallest"), own), f"alive-{i}")
        scratch.drop(made)
        scratch.drop(f"alive-{i - 1}")
        if seen.get["own"] <= seen.get["smallest"]:
            return alive.select("id", "score")
        alive = alive.filter(F.col("score") > seen.get["smallest"])
        kept = links.rows.join(alive.select(F.col("id").alias("src")), "src").join(alive.select(F.col("id").alias("dst")), "dst")
        links.floor = 0
        links.score(kept)
    raise AssertionError


def frontier_candidates(graph: Graph, levels: DataFrame, level: int) -> DataFrame:
    """Vertices one level out whose number of parents is below the largest degree
    of the subgraph up to ``level``; ``levels`` is the result of ``paths.bfs``."""
    inside = levels.filter(F.col("level") <= level).select("id")
    kept = graph.edges.select("src", "dst")
    for end in ("src", "dst"):
        kept = kept.join(inside.withColumnRenamed("id", end), end)
    largest = degrees(kept).agg(F.max("degree").alias("d")).scalar()
    return levels.filter((F.col("level") == level + 1) & (F.col("parents") < largest)).select("id", "parents")
