"""Vertex programs: a user's own message, merge and update, run to a fixpoint.

Edges and state are kept in buckets of their keys on disk (``plans.buckets``), so a step shuffles the messages, merged
before the shuffle, and nothing else (the senders too where hubs are split or the state has more keys than the vertex). Only
vertices that changed in a step send in the next. Every step is committed to a manifest, and a loop that
was stopped goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.buckets import State, Store
from ..plans.skew import PIECE, HotKeys, count_by


class Unfinished(RuntimeError):
    """The limit on the number of steps was reached before the loop came to its end."""


def steps(limit: int | None, what: str, first: int = 1) -> Iterator[int]:
    """The numbers from ``first`` on without end, or an error in the step after the limit."""
    for step in count(first):
        if limit is not None and step > limit + 1:
            raise Unfinished(f"{what} isn't complete after {limit} steps")
        yield step


class Adjacency:
    """Edges in buckets of their source for a loop; hubs split into pieces.

    ``counts`` (``src, n``) saves counting the edges per source when it is known. ``found`` names the
    columns of a table that an earlier run left in the store.
    """

    def __init__(self, store: Store, edges: DataFrame, counts: DataFrame | None = None, name: str = "edges", found: dict | None = None):
        spark = edges.sparkSession
        hot_path = f"{store.path}/{name}-hot"
        if found:
            self.hot = HotKeys.known("src", spark.read.parquet(hot_path) if found["hot"] else None)
            self.edges = store.read(name, found["schema"], self.hot.keys)
            return
        self.hot = HotKeys(count_by(edges, "src") if counts is None else counts, "src")
        if self.hot.any:
            self.hot.hot.write.parquet(hot_path)
        self.edges = store.save(self.hot.spread(edges, "dst"), name, self.hot.keys, deal=True)

    @property
    def entry(self) -> dict:
        """What finds the table again."""
        return {"hot": self.hot.any, "schema": ", ".join(f"`{c}` {t}" for c, t in self.edges.dtypes)}

    def expand(self, frontier: DataFrame) -> DataFrame:
        """Out-edges of the frontier rows (column ``id``), frontier columns kept."""
        starts = self.hot.replicate(frontier.withColumnRenamed("id", "src"))
        return starts.join(self.edges, self.hot.keys).drop(PIECE)


@dataclass(frozen=True)
class Program:
    """A vertex program in column expressions.

    ``message``: columns sent along each edge, over the edge's columns and the sender's state as ``src_<name>``.
    ``where``: which edges carry one. ``merge``: aggregates over the message columns; sums, counts, minima and
    the like, so that a vertex with very many messages is folded before the shuffle. ``update``: the new state for a
    step's number, over the old state (null at vertices that have none yet) and the merged columns. ``changed``: which updates
    are kept and send in the next step, over old, merged and new (``new_<name>``) columns; default: those that differ.
    ``group``: further key columns; each of their values is a run of its own over the same edges.
    ``sums``: state columns that are running sums. What an update gives for them is added, and is what the sender's ``src_<name>`` holds in
    the next step. Old values are not looked up then, so ``update`` and ``changed`` (default: all rows) see the merged columns only,
    and a step reads no state but the last step's rows.
    """

    message: dict[str, Column]
    merge: dict[str, Column]
    update: Callable[[int], dict[str, Column]]
    changed: Column | None = None
    where: Column | None = None
    group: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()


@dataclass(frozen=True)
class Iteration:
    """``state``: key and state columns of every vertex that has a state; ``steps``: steps in which
    something changed; ``path``: the run's folder, for ``resume``."""

    state: DataFrame
    steps: int
    path: str

    def delete(self, spark) -> None:
        """Delete the run's tables, and with them the state."""
        Store(spark, "", self.path).drop("")


def iterate(
    edges: DataFrame, start: DataFrame, program: Program, max_steps: int | None = None, stop_after: int | None = None,
    label: str = "program", resume: str | None = None, each_step: Callable[[int, DataFrame], None] | None = None,
    counts: DataFrame | None = None,
) -> Iteration:
    """Run a program from the rows of ``start`` (``id``, the group's and the state's columns; all send in the
    first step) until no vertex changes.

    ``stop_after`` ends after that many steps; ``max_steps`` bounds a loop that is meant to end by itself and raises
    ``Unfinished`` where it doesn't. ``resume`` is the folder of a run that was stopped: it goes on after its last
    committed step, with the edges and state kept there. ``each_step`` is given every step's changed rows.
    Vertices need a row in ``start`` only if they have a state before any message; an empty start ends at once.
    """
    store = Store(edges.sparkSession, label, resume)
    with store.loop():
        return _iterate(store, edges, start, program, max_steps, stop_after, each_step, counts)


def _iterate(store, edges, start, program, max_steps, stop_after, each_step, counts) -> Iteration:
    keys = [*program.group, "id"]
    state = State(store, keys, dict(start.select(*keys, *[c for c in start.columns if c not in keys]).dtypes), program.sums)
    done = store.last()
    if done:
        adjacency = Adjacency(store, edges, found=done["edges"])
        state.runs, last = [tuple(r) for r in done["runs"]], done["last"]
    else:
        adjacency, last = Adjacency(store, edges, counts), "step-0"
        seen = Observation()
        first = start.select(*keys, *state.columns).distinct().observe(seen, F.count(F.lit(1)).alias("n"))
        store.save(first, last, keys, deal=True)
        state.push(last, seen.get["n"])
        done = {"step": 0, "rows": seen.get["n"]}
        store.commit(0, {"edges": adjacency.entry, "runs": state.runs, "last": last, "rows": done["rows"]})
    finished, unread = done["step"], []
    if done["rows"]:
        for step in steps(max_steps, "the loop", finished + 1):
            if stop_after is not None and step > stop_after:
                break
            seen = Observation()
            rows = _step(state, adjacency, store.read(last, state.schema, keys), program, step)
            now = f"step-{step}"
            changed = store.save(rows.observe(seen, F.count(F.lit(1)).alias("n")), now, keys)
            n = seen.get["n"]
            if n:
                if each_step:
                    each_step(step, changed)
                unread += state.push(now, n)
                finished = step
            else:
                unread.append(now)
            store.commit(step, {"edges": adjacency.entry, "runs": state.runs, "last": now, "rows": n})
            last = now
            for name in [u for u in unread if u != last]:
                store.drop(name)
            unread = [u for u in unread if u == last]
            if not n:
                break
    return Iteration(state.table(), finished, store.path)


def _step(state: State, adjacency: Adjacency, senders: DataFrame, program: Program, step: int) -> DataFrame:
    """Keys and new state of the vertices that change."""
    sent = adjacency.expand(senders.select(*state.keys, *[F.col(c).alias(f"src_{c}") for c in state.columns]))
    if program.where is not None:
        sent = sent.filter(program.where)
    messages = sent.select(*program.group, F.col("dst").alias("id"), *[m.alias(c) for c, m in program.message.items()])
    inbox = messages.groupBy(*state.keys).agg(*[m.alias(c) for c, m in program.merge.items()])
    if program.sums:
        return _added(state, inbox, program, step)
    new = {c: e.cast(state.types[c]).alias(f"new_{c}") for c, e in program.update(step).items()}
    kept = [F.col(c).alias(f"new_{c}") for c in state.columns if c not in new]
    updated = state.look(inbox).select("*", *new.values(), *kept)
    changed = program.changed
    if changed is None:
        changed = F.lit(False)
        for c in state.columns:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return updated.filter(changed).select(*state.keys, *[F.col(f"new_{c}").alias(c) for c in state.columns])


def _added(state: State, inbox: DataFrame, program: Program, step: int) -> DataFrame:
    """Keys and what a step adds, by the messages alone."""
    kept = inbox if program.changed is None else inbox.filter(program.changed)
    new = program.update(step)
    return kept.select(*state.keys, *[new[c].cast(state.types[c]).alias(c) for c in state.columns])


def rank_to_tolerance(edges: DataFrame, vertices: DataFrame, tolerance: float = 1e-3, damping: float = 0.85, max_steps: int | None = None) -> DataFrame:
    """``id, rank``: ``rank = 1 - damping + damping * sum(rank(src) / out_degree(src))`` over in-edges.

    Only what a rank has gained since it was last passed on is sent, and only gains above the tolerance. A rank is the sum of its
    gains, so a step reads the last gains and the edges, which carry the number of their source's.
    """
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    fans = edges.select("src", "dst").join(counts, "src").withColumnRenamed("n", "fan")
    start = vertices.select("id", F.lit(1.0 - damping).alias("rank"))
    program = Program(
        message={"share": F.col("src_rank") / F.col("fan")}, merge={"shares": F.sum("share")},
        update=lambda step: {"rank": damping * F.col("shares")}, where=F.col("src_rank") > tolerance, sums=("rank",),
    )
    return iterate(fans, start, program, max_steps, label="rank", counts=counts).state.select("id", "rank")
