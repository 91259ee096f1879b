"""Measures of a graph held as tables: nodes(name) and edges(source, target, member, references).

The graph of a workspace has its entities as nodes, and an edge for each relationship that records use, counted from
them in one pass an entity. Degrees, components and cycles count distinct pairs of nodes. Tables of the measures are
as large as the graph, or pairs of its nodes; rounds end when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fold
from ..model import Model, Workspace
from .ranges import kept

_EDGES = "source string, target string, member string, references long"


def model_graph(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a model declares, with no references counted."""
    nodes = spark.createDataFrame([(e.name,) for e in model.entities], "name string")
    return nodes, spark.createDataFrame([(s, t, c, 0) for s, t, c, _ in model.edges()], _EDGES)


def record_graph(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The entities that have records, and the relationships that some record uses, with how many do."""
    nodes = edges = None
    for e in ws.model.entities:
        counts = ws[e.name].agg(F.count(F.lit(1)).alias("n"), *[F.count(r.column).alias(f"r{i}") for i, r in enumerate(e.relationships)])
        one = counts.where("n > 0").select(F.lit(e.name).alias("name"))
        nodes = one if nodes is None else nodes.unionByName(one)
        if e.relationships:
            uses = F.explode(F.array(*[F.struct(F.lit(e.name).alias("source"), F.lit(r.entity).alias("target"), F.lit(r.column).alias("member"), F.col(f"r{i}").alias("references")) for i, r in enumerate(e.relationships)]))
            some = counts.select(uses.alias("u")).select("u.*").where("references > 0")
            edges = some if edges is None else edges.unionByName(some)
    if edges is None:
        edges = nodes.sparkSession.createDataFrame([], _EDGES)
    return kept(nodes, "graph-nodes"), kept(edges, "graph-edges")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, in_degree, out_degree) over distinct pairs."""
    out = _pairs(edges).groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = _pairs(edges).groupBy(F.col("target").alias("entity")).agg(F.count(F.lit(1)).alias("in_degree"))
    met = nodes.select(F.col("name").alias("entity")).join(into, "entity", "left").join(out, "entity", "left")
    return met.select("entity", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])


def top_degrees(nodes: DataFrame, edges: DataFrame, by: str = "in_degree", n: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc(by), fold("entity")).limit(n)


def inbound(edges: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """(entity, member, references) of the relationships that lead to an entity, the first by name."""
    hit = edges.where(fold("target") == fold(F.lit(entity)))
    return hit.orderBy(fold("source"), fold("member")).limit(limit).select(F.col("source").alias("entity"), "member", "references")


def reached(edges: DataFrame) -> DataFrame:
    """(source, target) of every pair that a path of one edge or more joins; the length that is covered doubles each round."""
    now = kept(_pairs(edges), "reached")
    while True:
        on = now.select(F.col("source").alias("_m"), F.col("target").alias("_t"))
        more = kept(now.union(now.join(on, F.col("target") == F.col("_m")).select("source", F.col("_t"))).distinct(), "reached")
        if more.count() == now.count():
            return now
        now = more


def depth(nodes: DataFrame, edges: DataFrame) -> int | None:
    """The number of edges of the longest path; None with a cycle."""
    left, pairs, rounds = nodes.select("name"), _pairs(edges), 0
    while not left.isEmpty():
        # what refers to nothing that is left goes
        inner = pairs.join(left.select(F.col("name").alias("target")), "target", "left_semi")
        rest = kept(left.join(inner.select(F.col("source").alias("name")).distinct(), "name", "left_semi"), "depth")
        if rest.count() == left.count():
            return None
        left, rounds = rest, rounds + 1
    return max(rounds - 1, 0)


def loops(edges: DataFrame) -> DataFrame:
    """(loop, name): nodes that reach themselves, by the smallest name that they reach both ways."""
    all_pairs = reached(edges)
    back = all_pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return all_pairs.join(back, ["source", "target"], "left_semi").groupBy(F.col("source").alias("name")).agg(F.min("target").alias("loop")).select("loop", "name")


def loop_samples(edges: DataFrame) -> DataFrame:
    """(loop, sample): a shortest path around each loop from its first node, the first by name of equal ones."""
    rings = kept(loops(edges), "loops")
    inner = _pairs(edges).join(rings.select(F.col("name").alias("source"), "loop"), "source").join(rings.select(F.col("name").alias("target"), "loop"), ["target", "loop"])
    inner = kept(inner.select("loop", "source", "target"), "loop-edges")
    open_ = rings.where("name = loop").select("loop", F.col("name").alias("at"), F.col("name").alias("sample"))
    found, seen = None, rings.limit(0)
    while not open_.isEmpty():
        ahead = open_.join(inner.withColumnRenamed("source", "at"), ["loop", "at"]).select("loop", F.col("target").alias("at"), F.concat_ws(">", "sample", "target").alias("sample"))
        ahead = kept(ahead.groupBy("loop", "at").agg(F.min("sample").alias("sample")), "paths")
        ends = ahead.where("at = loop").select("loop", "sample")
        found = ends if found is None else found.unionByName(ends)
        seen = kept(seen.unionByName(ahead.select("loop", F.col("at").alias("name"))).distinct(), "seen")
        going = ahead.join(ends.select("loop"), "loop", "left_anti")
        before = open_.select("loop", F.col("at").alias("name"))
        open_ = going.join(before, [going.loop == before.loop, going["at"] == before.name], "left_anti").select("loop", "at", "sample")
    return found if found is not None else rings.select("loop", F.col("name").alias("sample")).limit(0)


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges, distinct_edges, components, max_depth, loops, average_in, and roots, sinks and isolated
    nodes by name, joined by commas."""
    both = edges.select("source", "target", "member").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "member"))
    least = nodes.join(reached(both).withColumnRenamed("source", "name"), "name", "left").groupBy("name").agg(F.min(F.least("name", F.coalesce("target", "name"))).alias("low"))
    components = least.agg(F.countDistinct("low").alias("components"))
    pairs = _pairs(edges)
    of = degrees(nodes, edges)
    listed = lambda test, name: F.array_join(F.sort_array(F.collect_list(F.when(test, F.col("entity")))), ",").alias(name)
    sides = of.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.avg("in_degree"), F.lit(0.0)).alias("average_in"), listed(F.col("in_degree") == 0, "roots"), listed(F.col("out_degree") == 0, "sinks"), listed((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "isolated"))
    rings = loops(edges).agg(F.countDistinct("loop").alias("loops"))
    counts = edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("distinct_edges")))
    # one row each
    return sides.crossJoin(counts).crossJoin(components).crossJoin(rings).withColumn("max_depth", F.lit(depth(nodes, edges)).cast("long"))
