"""Property graphs as two DataFrames and the primitives over them.

``vertices(id bigint, ...)``, ``edges(src bigint, dst bigint, attr ...)``;
directed, parallel edges allowed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame) -> Graph:
        """Vertices are the distinct ends of the edges."""
        return Graph(ends(edges).select("id").distinct(), edges)

    def map_vertices(self, **columns: Column) -> Graph:
        return Graph(self.vertices.withColumns(columns), self.edges)

    def map_edges(self, **columns: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumns(columns))

    def map_triplets(self, **columns: Column) -> Graph:
        """Edge columns from both ends: refer to ``src_<name>`` and ``dst_<name>``."""
        kept = self.edges.columns + [c for c in columns if c not in self.edges.columns]
        return Graph(self.vertices, triplets(self).withColumns(columns).select(*kept))

    def reverse(self) -> Graph:
        return Graph(self.vertices, reverse(self.edges))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: ``id, other, outgoing``; two rows per edge."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("outgoing")),
                F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("outgoing")),
            )
        ).alias("e")
    ).select("e.*")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """Total degree; a self-loop counts twice, vertices without edges are absent."""
    return ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def all_degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree from one shuffle."""
    out = F.col("outgoing").cast("int")
    return ends(edges).groupBy("id").agg(
        F.sum(1 - out).alias("in_degree"), F.sum(out).alias("out_degree"), F.count(F.lit(1)).alias("degree")
    )


def extreme(df: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """Row with the largest (or smallest) value; the smaller id wins a tie."""
    key = F.struct(F.col(value).alias("v"), (-F.col("id") if largest else F.col("id")).alias("i"))
    pick = F.max(key) if largest else F.min(key)
    best = df.agg(pick.alias("best"))
    best_id = -F.col("best.i") if largest else F.col("best.i")
    return best.filter("best is not null").select(best_id.alias("id"), F.col("best.v").alias(value))


def with_degrees(graph: Graph) -> DataFrame:
    """Vertices with in and out degree, 0 where there is none."""
    d = all_degrees(graph.edges).select("id", "in_degree", "out_degree")
    return graph.vertices.join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def equal_in_out(graph: Graph) -> DataFrame:
    return with_degrees(graph).filter("in_degree = out_degree")


def with_properties(vertices: DataFrame, properties: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Vertices with the columns of a user table, defaults where it has no row."""
    return vertices.join(properties.select("id", *defaults), "id", "left").na.fill(defaults)


def update_matching(vertices: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` only where ``updates`` has a row for the vertex."""
    new = updates.select("id", F.col(column).alias("_new"))
    return vertices.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def _prefixed(vertices: DataFrame, side: str) -> DataFrame:
    return vertices.select(*[F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in vertices.columns])


def triplets(graph: Graph) -> DataFrame:
    """Edges with the attributes of both ends as ``src_<name>`` and ``dst_<name>``.

    The two joins are plain ones: adaptive execution splits the partition of a vertex with
    very many edges by its measured size, without counting them first.
    """
    half = graph.edges.join(_prefixed(graph.vertices, "src"), "src")
    return half.join(_prefixed(graph.vertices, "dst"), "dst")


def subgraph(graph: Graph, vertex: Column | None = None, edge: Column | None = None) -> Graph:
    """Vertices and edges that pass their predicates; an edge needs both ends kept."""
    vertices = graph.vertices.filter(vertex) if vertex is not None else graph.vertices
    edges = graph.edges.filter(edge) if edge is not None else graph.edges
    if vertex is not None:
        kept = vertices.select("id")
        columns = edges.columns
        for end in ("src", "dst"):
            edges = edges.join(kept.withColumnRenamed("id", end), end)
        edges = edges.select(*columns)
    return Graph(vertices, edges)


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def aggregate_messages(
    graph: Graph, reduce: Iterable[Column], to_dst: bool = True, where: Column | None = None
) -> DataFrame:
    """Fold one message per edge at its receiving end.

    ``reduce`` are aggregate columns over triplet columns. Each must be an
    algebraic aggregate (sum, min, max_by ...) so that a vertex with very many
    edges is folded before the shuffle.
    """
    view = triplets(graph)
    if where is not None:
        view = view.filter(where)
    return view.groupBy(F.col("dst" if to_dst else "src").alias("id")).agg(*reduce)


def oldest_follower(graph: Graph, age: str = "age") -> DataFrame:
    """Per vertex the in-neighbour with the largest age (smaller id on a tie);
    null where a vertex has no in-edge."""
    best = F.max(F.struct(F.col(f"src_{age}").alias("a"), (-F.col("src")).alias("i")))
    found = aggregate_messages(graph, [best.alias("best")])
    return (
        graph.vertices.join(found, "id", "left")
        .select("id", (-F.col("best.i")).alias("follower"), F.col("best.a").alias("follower_age"))
    )
