"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.plans.ordering import running
from foliomill.plans.workspace import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge to another; the label is the smallest node.

    Each round hangs every node on its smallest neighbour, shortens the trees to stars by
    pointer jumping, and contracts each star to its root; what edges remain go on to the
    next round. Both loops take a number of rounds logarithmic in the component. Every
    round is written to the shared folder, so lineage stays short. Null ends and loops are
    ignored.
    """
    rest = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, labels = materialize(rest, "cc-edges"), None
    while not rest.isEmpty() or labels is None:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "cc-parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = materialize(parent.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")), "cc-parents")
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            onto = parent.select(F.col("node").alias("component"), "parent")
            labels = materialize(labels.join(onto, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
        to_a, to_b = parent.select(F.col("node").alias("a"), F.col("parent").alias("x")), parent.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        rest = rest.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        rest = materialize(rest, "cc-edges")
    return labels


def undirected(edges: DataFrame) -> DataFrame:
    """(source, target, similarity): one row per pair that has an edge either way, smaller node first."""
    ends = edges.select(F.least("chunk_id", "neighbor_id").alias("source"), F.greatest("chunk_id", "neighbor_id").alias("target"), "similarity")
    return ends.where("source <> target").groupBy("source", "target").agg(F.max("similarity").alias("similarity"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over undirected edges."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every listed node; nodes without edges are components of one.

    Links to nodes outside the list still join components.
    """
    found = connected_components(edges, "source", "target")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cluster_sizes(components: DataFrame, least: int = 2) -> DataFrame:
    """(component, members) of components of at least ``least`` nodes."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def dense_clusters(components: DataFrame, order: str = "node") -> DataFrame:
    """(node, component, cluster): clusters numbered from 0 in the order of their first member by ``order``."""
    first = components.groupBy("component").agg(F.min(order).alias("first"))
    numbered = running(first, [F.col("first"), F.col("component")]).select("component", F.col("position").alias("cluster"))
    return components.join(numbered, "component").select("node", "component", "cluster")


def graph_nodes(nodes: DataFrame, edges: DataFrame, components: DataFrame, documents: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, document_id, document_name, degree, cluster, cluster_size, hue) of ``nodes`` (node, document_id).

    ``documents`` gives names (file_name; ``?`` where there is none), ``colours`` hues by
    document; a node without edges has degree 0 and a cluster of its own.
    """
    clusters = dense_clusters(components)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    out = nodes.select("node", "document_id").join(clusters, "node", "left").join(sizes, "component", "left").join(degrees(edges), "node", "left")
    out = out.join(documents.select("document_id", F.col("file_name").alias("document_name")), "document_id", "left").join(colours.select("document_id", "hue"), "document_id", "left")
    return out.select("node", "document_id", F.coalesce("document_name", F.lit("?")).alias("document_name"), F.coalesce("degree", F.lit(0)).alias("degree"), "cluster", F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"), "hue")


def document_graph(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc_a, doc_b, links, similarity): edges between chunks of different documents, by pair; ``owners`` is (node, document)."""
    a = owners.select(F.col("node").alias("source"), F.col("document").alias("x"))
    b = owners.select(F.col("node").alias("target"), F.col("document").alias("y"))
    pairs = edges.join(a, "source").join(b, "target").where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.count(F.lit(1)).alias("links"), F.avg("similarity").alias("similarity"))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(neighbor, similarity) of one node, nearest first."""
    here = edges.where((F.col("source") == F.lit(node)) | (F.col("target") == F.lit(node)))
    other = F.when(F.col("source") == F.lit(node), F.col("target")).otherwise(F.col("source"))
    return here.select(other.alias("neighbor"), "similarity").orderBy(F.desc("similarity"), "neighbor")


def highlight(nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """(node, degree, matched, value): display size of each node for a search; no match at all highlights nothing.

    A matched node grows by 3, the others shrink to 0.4 of their size (0.5 at least).
    """
    hit = matches.select(F.col("chunk_id").alias("node"), F.lit(True).alias("hit"))
    any_hit = matches.agg((F.count(F.lit(1)) > 0).alias("any_hit"))
    base = nodes.select("node").join(degrees(edges), "node", "left").fillna(0, ["degree"]).join(hit, "node", "left").join(F.broadcast(any_hit))
    size = F.greatest(F.lit(1.0), F.col("degree").cast("double"))
    matched = F.coalesce("hit", F.lit(False))
    value = F.when(~F.col("any_hit"), size).when(matched, size + 3).otherwise(F.greatest(F.lit(0.5), 0.4 * size))
    return base.select("node", "degree", matched.alias("matched"), value.alias("value"))
