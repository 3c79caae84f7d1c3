"""Connected components of a graph whose edges come in batches, with cluster numbers that stay.

Three tables hold what is known, a part for each batch: ``nodes`` (node, label) has every node
once, with the component it fell into at first; ``moves`` (component, into) says where a component
is today, the latest batch that names it counts; ``numbers`` (component, cluster) likewise. A batch
replaces the ends of its edges by their components of today and contracts only these, so
the edges of earlier batches are never read again, and it writes rows only for new nodes and for
components that have turned. The node table, two values a node, is read once a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.graph import connected_components
from foliomill.plans.ordering import running
from foliomill.plans.workspace import materialize
from foliomill.streaming.batches import BatchTables, committed


class ComponentStore:
    """Components kept in the folder ``store``.

    Batches are added in the order of their numbers. A component is named by its smallest
    node; its cluster number is given when it first appears (batch by batch, by smallest node), and a
    component that others join keeps the smallest of their numbers. A number that
    has been joined to another is not given again. Null ends and loops are ignored; a node's
    type is that of the first batch's ends.
    """

    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = spark, store

    def _latest(self, table: str, value: str) -> DataFrame | None:
        rows = committed(self.spark, self.store, table)
        return None if rows is None else rows.groupBy("component").agg(F.max_by(value, "batch").alias(value))

    def labels(self) -> DataFrame:
        """(node, component) of every node that had an edge to another so far."""
        nodes = committed(self.spark, self.store, "nodes")
        if nodes is None:
            raise ValueError("no batch has been added yet")
        first = nodes.select("node", F.col("label").alias("component"))
        return first.join(self._latest("moves", "into"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))

    def numbers(self) -> DataFrame:
        """(component, cluster) of today's components."""
        found = self._latest("numbers", "cluster")
        if found is None:
            raise ValueError("no batch has been added yet")
        return found.join(self._latest("moves", "into"), "component", "left_anti")

    def clusters(self) -> DataFrame:
        """(node, component, cluster) of every node so far."""
        return self.labels().join(self.numbers(), "component").select("node", "component", "cluster")

    def add(self, edges: DataFrame, number: int, source: str = "source", target: str = "target") -> None:
        """Batch ``number``; one that was added before changes nothing, one that was cut short goes on."""
        part = BatchTables(self.spark, self.store, number)
        if part.is_committed():
            return
        found = part.stage("found", lambda: self._contract(edges.select(F.col(source).alias("a"), F.col(target).alias("b"))))
        part.stage("nodes", lambda: found.where("not known").select("node", F.col("component").alias("label")))
        part.stage("moves", lambda: self._turned(found))
        part.stage("numbers", lambda: self._numbered(found))
        part.commit(found.agg(F.count(F.lit(1)).alias("ends"), F.count_if(~F.col("known")).alias("new_nodes"), F.count_if(F.expr("known and root <> component")).alias("turned_nodes")))

    def _contract(self, pairs: DataFrame) -> DataFrame:
        """(node, root, known, component): the batch's nodes, their component before it and after it."""
        pairs = materialize(pairs.where("a <> b").distinct(), "cc-batch")
        ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        if committed(self.spark, self.store, "nodes") is None:
            sides = ends.select("node", F.col("node").alias("root"), F.lit(False).alias("known"))
        else:
            sides = ends.join(self.labels(), "node", "left").select("node", F.coalesce("component", "node").alias("root"), F.col("component").isNotNull().alias("known"))
        sides = materialize(sides, "cc-ends")
        a, b = (sides.select(F.col("node").alias(end), F.col("root").alias(root)) for end, root in (("a", "x"), ("b", "y")))
        joined = connected_components(pairs.join(a, "a").join(b, "b").select("x", "y"), "x", "y")
        return sides.join(joined.select(F.col("node").alias("root"), "component"), "root", "left").select("node", "root", "known", F.coalesce("component", "root").alias("component"))

    def _turned(self, found: DataFrame) -> DataFrame:
        """(component, into) of all components, of whatever batch, that end in another one from this batch on."""
        turned = found.where("known and root <> component").select("root", "component").distinct()
        own = turned.select(F.col("root").alias("component"), F.col("component").alias("into"))
        before = self._latest("moves", "into")
        if before is None:
            return own
        onto = turned.select(F.col("root").alias("into"), F.col("component").alias("onto"))
        return own.unionByName(before.join(onto, "into").select("component", F.col("onto").alias("into")))

    def _numbered(self, found: DataFrame) -> DataFrame:
        """(component, cluster) of components that are new or have got another name or number."""
        before = self._latest("numbers", "cluster")
        roots = found.groupBy("component", "root").agg(F.max("known").alias("known"))
        if before is None:
            held = roots.select("component", "root", F.lit(None).cast("long").alias("cluster"))
            start = F.lit(0)
        else:
            held = roots.join(before.select(F.col("component").alias("root"), "cluster"), "root", "left").select("component", "root", F.when(F.col("known"), F.col("cluster")).alias("cluster"))
            # of all numbers that were ever given, those that have been joined to others included
            given = committed(self.spark, self.store, "numbers").agg(F.max("cluster")).first()[0]
            start = F.lit(0 if given is None else given + 1)
        each = held.groupBy("component").agg(F.min("cluster").alias("cluster"), F.max(F.when(F.col("root") == F.col("component"), F.col("cluster"))).alias("own"))
        each = materialize(each, "cc-numbers")
        fresh = running(each.where("cluster is null").select("component"), [F.col("component")])
        kept = each.where("cluster is not null and not (own <=> cluster)").select("component", "cluster")
        return kept.unionByName(fresh.select("component", (F.col("position") + start).cast("long").alias("cluster")))
