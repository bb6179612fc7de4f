"""Hop distances, shortest paths, closeness and betweenness.

All loops run until nothing changes: only vertices reached or improved in the last step meet
the edges. Edges and state lie in buckets of their keys on disk, and a step shuffles what
is sent between them. A caller's limit on the steps that would leave the result incomplete raises ``Unfinished``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.buckets import State, Store
from ..plans.ranges import dense_index
from ..plans.scratch import Scratch
from ..plans.skew import HotKeys, count_by
from .credit import credit_totals
from .programs import Adjacency, Program, Unfinished, iterate, steps

__all__ = [
    "Adjacency", "Betweenness", "Unfinished", "adjacency_of", "betweenness", "betweenness_totals", "bfs", "harmonic_closeness",
    "shortest_paths", "steps",
]


@contextmanager
def adjacency_of(edges: DataFrame, counts: DataFrame | None = None) -> Iterator[Adjacency]:
    """Edges in buckets for one loop, deleted however the loop ends."""
    store = Store(edges.sparkSession, "adjacency")
    try:
        yield Adjacency(store, edges, counts)
    finally:
        store.drop("edges")
        store.close()


def bfs(edges: DataFrame, sources: DataFrame, depth: int | None = None, max_steps: int | None = None) -> DataFrame:
    """``id, level, parents``: hops from the nearest source, and the number of
    edges that reach the vertex from the level before (0 for a source).

    ``depth`` asks for the levels up to that one only; ``max_steps`` bounds a search
    that is meant to be complete, and raises where it isn't.
    """
    start = sources.select(F.col("id").cast("long"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("parents"))
    program = Program(
        message={"one": F.lit(1)}, merge={"found": F.count("one")},
        update=lambda step: {"level": F.lit(step), "parents": F.col("found")}, changed=F.col("level").isNull(),
    )
    return iterate(edges.select("src", "dst"), start, program, max_steps, depth, "bfs").state


def shortest_paths(
    edges: DataFrame, sources: DataFrame, weight: str | None = "attr", allowed: Column | None = None,
    max_steps: int | None = None, width: float | None = None,
) -> DataFrame:
    """``source, id, distance`` for every reachable pair, all sources in one loop.

    ``sources`` has column ``id`` and may carry more columns; ``allowed`` may
    compare those with edge columns to bar edges per source. Weights must not
    be negative; ``weight=None`` counts hops. Weighted distances are settled in ranges of
    ``width`` (default: the mean weight), so that an edge is seldom followed before its source is final.
    """
    extra = [c for c in sources.columns if c != "id"]
    start = sources.select(F.col("id").cast("long").alias("source"), *extra, F.col("id").cast("long"), F.lit(0.0).alias("distance")).distinct()
    if weight:
        return _settled(edges, start, ["source", *extra, "id"], F.col(weight).cast("double"), allowed, max_steps, width)
    program = Program(
        message={"offer": F.col("src_distance") + 1.0}, merge={"best": F.min("offer")},
        update=lambda step: {"distance": F.col("best")}, changed=F.col("distance").isNull(), where=allowed, group=("source", *extra),
    )
    return iterate(edges, start, program, max_steps, label="hops").state


def _settled(
    edges: DataFrame, start: DataFrame, keys: list[str], cost: Column, allowed: Column | None, max_steps: int | None, width: float | None
) -> DataFrame:
    store = Store(edges.sparkSession, "sssp")
    with store.loop():
        return _DeltaStepping(store, edges, start, keys, cost, allowed, max_steps, width).run()


class _DeltaStepping:
    """Delta-stepping (Meyer, Sanders 2003). Distances fall into ranges of one width. Within a range, light edges (no heavier
    than the width) are followed step by step from what improved; heavy edges once, when the range is
    final. Improvements beyond the range are filed under their own and not looked at before, so a step
    reads the active range and, bucket by bucket, the state that its messages meet."""

    def __init__(self, store: Store, edges: DataFrame, start: DataFrame, keys: list[str], cost: Column, allowed: Column | None, max_steps: int | None, width: float | None):
        if width is None:
            width = edges.agg(F.avg(cost)).first()[0]
        self.width = width if width and width > 0 else 1.0
        self.store, self.keys, self.cost, self.allowed = store, keys, cost, allowed
        self.light = Adjacency(store, edges.filter(cost <= self.width), name="light")
        self.heavy = Adjacency(store, edges.filter(cost > self.width), name="heavy")
        self.state = State(store, keys, dict(start.select(*keys, "distance").dtypes))
        self.steps = steps(max_steps, "the search")
        self.start = start
        self.filed = f"{store.path}/filed"
        self.unread: list[str] = []

    def run(self) -> DataFrame:
        near, n = self._save(self.start, "start", True)
        self.state.push("start", n)
        place = 0
        while n:
            self._settle(near, place)
            place = self._next(place)
            if place is None:
                break
            near, n = self._open(place), 1
        return self.state.table()

    def _settle(self, near: DataFrame, place: int) -> None:
        """Make the distances of a range final, and send what they offer beyond it."""
        end, parts = (place + 1) * self.width, []
        while True:
            parts.append(near)
            improved, within, beyond = self._relax(self.light, near, end)
            if beyond:
                self._file(improved.filter(F.col("distance") >= end))
            if not within:
                break
            near = improved.filter(F.col("distance") < end)
        range_ = parts[0]
        for part in parts[1:]:
            range_ = range_.unionByName(part)
        final = range_.groupBy(*self.keys).agg(F.min("distance").alias("distance")) if len(parts) > 1 else range_
        improved, _, beyond = self._relax(self.heavy, final, end)
        if beyond:
            self._file(improved)
        for name in self.unread:
            self.store.drop(name)
        self.unread = []

    def _relax(self, adjacency: Adjacency, rows: DataFrame, end: float) -> tuple[DataFrame, int, int]:
        """Better distances over the rows' out-edges, and how many lie within and beyond the range."""
        reach = adjacency.expand(rows.withColumnRenamed("distance", "_so_far"))
        if self.allowed is not None:
            reach = reach.filter(self.allowed)
        group = [k for k in self.keys if k != "id"]
        offers = reach.select(*group, F.col("dst").alias("id"), (F.col("_so_far") + self.cost).alias("offer"))
        best = self.state.look(offers.groupBy(*self.keys).agg(F.min("offer").alias("offer")))
        better = best.filter(F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).select(*self.keys, F.col("offer").alias("distance"))
        name, seen = f"step-{next(self.steps)}", Observation()
        far = F.count(F.when(F.col("distance") >= end, 1))
        saved = self.store.save(better.observe(seen, F.count(F.lit(1)).alias("n"), far.alias("far")), name, self.keys)
        n, beyond = seen.get["n"], seen.get["far"]
        if n:
            self.unread += self.state.push(name, n)
        else:
            self.store.drop(name)
        return saved, n - beyond, beyond

    def _file(self, rows: DataFrame) -> None:
        place = F.floor(F.col("distance") / F.lit(self.width)).alias("place")
        rows.select("*", place).write.partitionBy("place").mode("append").parquet(self.filed)

    def _next(self, after: int) -> int | None:
        """The next range that holds filed distances."""
        files, folder = self.store.files(self.filed)
        if not files.exists(folder):
            return None
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return min((p for n in names if n.startswith("place=") and (p := int(n[6:])) > after), default=None)

    def _open(self, place: int) -> DataFrame:
        """The range's filed distances that are still the best known ones."""
        rows = self.store.spark.read.schema(self.state.schema).parquet(f"{self.filed}/place={place}")
        best = rows.groupBy(*self.keys).agg(F.min("distance").alias("_filed"))
        name = f"range-{place}"
        near, _ = self._save(self.state.look(best).filter("_filed = distance").select(*self.keys, "distance"), name)
        self.store.drop(f"filed/place={place}")
        self.unread.append(name)
        return near

    def _save(self, df: DataFrame, name: str, deal: bool = False) -> tuple[DataFrame, int]:
        seen = Observation()
        saved = self.store.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name, self.keys, deal)
        return saved, seen.get["n"]


BITS, TOGETHER = 64, 4096


def harmonic_closeness(
    edges: DataFrame, sources: DataFrame, weight: str | None = None, allowed: Column | None = None, batch: int = TOGETHER
) -> DataFrame:
    """Sum of inverse distances from each source to the vertices it reaches.

    Hops are counted for 64 sources at a time: a vertex keeps one mask of the sources that have reached it, and a step's messages
    are masks, merged by OR. Sources that carry equal columns (which ``allowed`` may compare) share masks; about ``batch`` sources go
    along in one loop, of which only the number of vertices per source and level is kept. With weights, distances are kept per source.
    """
    extra = [c for c in sources.columns if c != "id"]
    order = F.struct(*extra, "id").alias("order")
    rows = sources.select(F.col("id").cast("long"), *extra).distinct()
    ranked = dense_index(rows.select(order), "order", "place").select("order.*", "place")
    per_batch = min(BITS, batch) if weight is None else 1
    batches = max(1, batch // per_batch)
    numbered = Scratch(edges.sparkSession, "closeness-sources").save(
        ranked.select("*", F.floor(F.col("place") / per_batch).alias("batch"), F.pmod("place", F.lit(per_batch)).cast("int").alias("bit")), "rows"
    )
    total = numbered.agg(F.max("batch")).first()[0]
    scratch, out = Scratch(edges.sparkSession, "closeness"), None
    for first in range(0, (total or 0) + 1, batches):
        part = numbered.filter(F.col("batch").between(first, first + batches - 1))
        if weight is None:
            sums = _mask_sums(edges, part, extra, allowed, scratch, first)
        else:
            found = shortest_paths(edges, part.select("id", *extra), weight, allowed)
            inverse = F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(0.0)
            sums = found.groupBy(F.col("source").alias("id"), *extra).agg(F.sum(inverse).alias("closeness"))
        saved = scratch.save(sums, f"part={first}")
        out = saved if out is None else out.unionByName(saved)
    return out


def _mask_sums(edges: DataFrame, sources: DataFrame, extra: list[str], allowed: Column | None, scratch: Scratch, run: int) -> DataFrame:
    group = ("batch", *extra)
    mine = F.expr("shiftleft(1L, bit)")
    start = sources.groupBy(*group, "id").agg(F.bit_or(mine).alias("seen")).withColumn("fresh", F.col("seen"))
    program = Program(
        message={"mask": F.col("src_fresh")}, merge={"masks": F.bit_or("mask")},
        update=lambda step: {
            "seen": F.coalesce("seen", F.lit(0)).bitwiseOR(F.col("masks")),
            "fresh": F.col("masks").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))),
        },
        changed=F.col("new_fresh") != 0, where=allowed, group=group,
    )
    bits = F.array(*[F.sum(F.shiftrightunsigned("fresh", j).bitwiseAND(F.lit(1).cast("long"))) for j in range(BITS)])
    schemas = []

    def count_level(step: int, changed: DataFrame) -> None:
        saved = scratch.save(changed.groupBy(*group).agg(bits.alias("n")), f"levels-{run}/level={step}")
        schemas.append(", ".join(f"`{c}` {t}" for c, t in saved.dtypes))

    done = iterate(edges, start, program, label="closeness", each_step=count_level)
    done.delete(edges.sparkSession)
    owners = sources.select("id", *extra, "batch", "bit")
    if not schemas:
        return owners.select("id", *extra, F.lit(0.0).alias("closeness"))
    rows = scratch.table(f"levels-{run}", schemas[0] + ", level int")
    counts = rows.select(*group, "level", F.posexplode("n").alias("bit", "n")).filter("n > 0")
    sums = counts.groupBy(*group, "bit").agg(F.sum(F.col("n") / F.col("level")).alias("closeness"))
    same = (F.col("s.batch") == F.col("c.batch")) & (F.col("s.bit") == F.col("c.bit"))
    for c in extra:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
    joined = owners.alias("s").join(sums.alias("c"), same, "left")
    return joined.select("s.id", *[F.col(f"s.{c}") for c in extra], F.coalesce("c.closeness", F.lit(0.0)).alias("closeness"))


class Betweenness:
    """``credit(root, id, level, sigma, credit)`` and ``edge_credit(root, src, dst, credit)``."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices = vertices
        self.edges = edges


def betweenness(edges: DataFrame, roots: DataFrame, max_steps: int | None = None) -> Betweenness:
    """Shortest-path credit from each root over directed edges (Brandes 2001).

    Forward, level by level, the number of shortest paths ``sigma``; backward,
    ``credit(v) = 1 + sum sigma(v)/sigma(w) * credit(w)`` over the next level.
    The root itself gets no credit row. All roots advance together; see ``betweenness_totals`` for many.
    """
    with adjacency_of(edges.select("src", "dst")) as adjacency:
        return _betweenness(adjacency, Scratch(edges.sparkSession, "betweenness"), edges, roots, max_steps)


def betweenness_totals(edges: DataFrame, roots: DataFrame, together: int = 64, max_steps: int | None = None) -> Betweenness:
    """``vertices(id, roots, credit)`` and ``edges(src, dst, credit)``: the credit summed over the roots, and the number of
    roots that reach the vertex.

    Roots go in batches of ``together`` (at most 64); a batch is added to the running totals and its own
    tables are deleted, so what is kept is vertices and edges, however many roots there are. With a sample of all
    vertices as roots (``corpus.sample_by_key``), credits divided by the sampling rate estimate those of all.
    """
    return Betweenness(*credit_totals(edges, roots, together, max_steps))


def _betweenness(
    adjacency: Adjacency, scratch: Scratch, edges: DataFrame, roots: DataFrame, max_steps: int | None
) -> Betweenness:
    targets = HotKeys(count_by(edges, "dst"), "dst")
    seed = roots.select(F.col("id").cast("long").alias("root"), F.col("id").cast("long"), F.lit(1.0).alias("sigma"), F.lit(0).alias("level"))
    program = Program(
        message={"paths": F.col("src_sigma")}, merge={"total": F.sum("paths")},
        update=lambda step: {"sigma": F.col("total"), "level": F.lit(step)}, changed=F.col("level").isNull(), group=("root",),
    )
    found = iterate(edges.select("src", "dst"), seed, program, max_steps, label="forward")
    depth = found.steps
    found.state.write.partitionBy("level").parquet(f"{scratch.base}/reached")
    found.delete(edges.sparkSession)
    schema = "root bigint, id bigint, sigma double, level int"
    reached = scratch.table("reached", schema)
    credit_schema = "root bigint, id bigint, sigma double, credit double, level int"
    edge_schema = "root bigint, src bigint, dst bigint, credit double, level int"
    below = scratch.save(
        reached.filter(F.col("level") == depth).select("root", "id", "sigma", F.lit(1.0).alias("credit")),
        f"credit/level={depth}",
    )
    for level in range(depth - 1, -1, -1):
        here = reached.filter(F.col("level") == level).select("root", "id", "sigma")
        child = below.select("root", F.col("id").alias("dst"), F.col("sigma").alias("_s"), F.col("credit").alias("_c"))
        shares = scratch.save(
            targets.join(adjacency.expand(here), child, by=["src"], also=("root",))
            .select("root", "src", "dst", (F.col("sigma") / F.col("_s") * F.col("_c")).alias("credit")),
            f"edges/level={level}",
        )
        gained = shares.groupBy("root", F.col("src").alias("id")).agg(F.sum("credit").alias("_c"))
        below = scratch.save(
            here.join(gained, ["root", "id"], "left").select(
                "root", "id", "sigma", (F.lit(1.0) + F.coalesce("_c", F.lit(0.0))).alias("credit")
            ),
            f"credit/level={level}",
        )
    credits = scratch.table("credit", credit_schema).filter("level > 0 or root <> id")
    if depth == 0:
        no_edges = edges.sparkSession.createDataFrame([], "root bigint, src bigint, dst bigint, credit double")
        return Betweenness(credits, no_edges)
    return Betweenness(credits, scratch.table("edges", edge_schema).drop("level"))
