"""Connected components by least-label propagation with pointer jumping; every round is cut off at a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.operators import shared


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared.root(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = _cut, release: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(node, component) for every node of an edge (a, b); the component is its least node.

    ``cut`` gives a frame whose lineage ends, ``release`` is told of such frames once nothing reads them.
    """
    both = cut(edges.selectExpr("a AS node", "b AS other").union(edges.selectExpr("b AS node", "a AS other")).filter("node <> other").distinct())
    first = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"))
    label = cut(first.withColumn("before", F.col("node")))
    while not label.filter("before <> component").isEmpty():
        old = label.select("node", "component")
        near = both.join(old.selectExpr("node AS other", "component AS c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = old.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "c").alias("component"))
        up = old.selectExpr("node AS component", "component AS top")
        earlier, label = label, cut(step.join(up, "component").select("node", F.least("component", "top").alias("component"), "before"))
        release(earlier)
    release(both)
    return label.select("node", "component")


def groups(edges: DataFrame) -> DataFrame:
    """Components of two nodes or more with their sizes."""
    return components(edges).groupBy("component").agg(F.count("*").alias("size")).filter("size >= 2")


def kept_edges(edges: DataFrame, touched: DataFrame, node: str) -> DataFrame:
    """Edges none of whose ends was changed or removed; new ones come from a delta join."""
    t = touched.select(F.col(node)).distinct()
    return edges.join(t.withColumnRenamed(node, "a"), "a", "left_anti").join(t.withColumnRenamed(node, "b"), "b", "left_anti")


def updated_components(labels: DataFrame, left: DataFrame, removed: DataFrame, added: DataFrame, cut: Callable[[DataFrame], DataFrame] = _cut) -> tuple[DataFrame, DataFrame]:
    """(labels, touched): the components after edges went and came, from those before.

    ``labels`` (node, component: its least node) are of the graph before; ``left`` are its edges (a, b) without the ``removed``
    ones, ``added`` those to put in. Only components that lost an edge are computed anew, from their own edges; the rest keep
    their labels. Added edges then join whole components: the labels are the nodes of that step, so it has as many edges as
    were added, however large the components are. Nodes without edges have no label. ``touched`` are the nodes of the
    components that were computed anew.
    """
    labels = cut(labels.select("node", "component"))
    ends = lambda e: e.selectExpr("a AS node").union(e.selectExpr("b AS node")).distinct()
    hurt = cut(labels.join(ends(removed), "node").select("component").distinct())
    touched = cut(labels.join(hurt, "component", "left_semi").select("node"))
    inside = left.join(touched.withColumnRenamed("node", "a"), "a", "left_semi")
    base = cut(labels.join(hurt, "component", "left_anti").select("node", "component").unionByName(components(inside, cut)))
    # labels as nodes: a node that is new is its own label
    named = base.selectExpr("node", "component AS label")
    first = added.join(named.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("label", "a").alias("x"), "a", "b")
    both = cut(first.join(named.withColumnRenamed("node", "b"), "b", "left").select("a", "b", "x", F.coalesce("label", "b").alias("y")))
    joined = components(both.selectExpr("x AS a", "y AS b"), cut).selectExpr("node AS component", "component AS joined")
    new = ends(both).join(base, "node", "left_anti").select("node", F.col("node").alias("component"))
    after = base.unionByName(new).join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return after, touched


def nearest_marked(paths: DataFrame, node: str, path: str, marked: DataFrame, folder: str) -> DataFrame:
    """(node, found): the nearest marked folder of each path, itself included, or null. Every path meets only its own ancestors."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder_")))
    every = paths.filter(F.col(path).isNotNull()).select(F.col(node), F.inline(up))
    found = every.join(marked.select(F.col(folder).alias("folder_")).distinct(), "folder_").groupBy(node).agg(F.max_by("folder_", "depth").alias("found"))
    return paths.select(node).join(found, node, "left")
